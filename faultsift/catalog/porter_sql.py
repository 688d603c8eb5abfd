"""Porter stemming as SQL, to check the column version against."""

from __future__ import annotations

V, C = "[aeiouy]", "[^aeiouy]"
M0 = f"^{C}*{V}+{C}"
M1 = f"^{C}*{V}+{C}+{V}+{C}"
ME1 = f"^{C}*{V}+{C}+{V}*$"
SHORT = f"{C}{V}[^aeiouywxY]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yY)$"


def _like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _cut(x: str, n: int | str) -> str:
    return f"left({x}, length({x}) - {n})"


def _case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def _suffix_step(table: dict[str, str]) -> str:
    pattern = "(" + "|".join(table) + ")$"
    found = f"regexp_extract(w, '{pattern}', 1)"
    stem = _cut("w", f"length({found})")
    new = "CASE " + found + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"
    return f"CASE WHEN {found} <> '' AND {_like(stem, M0)} THEN {stem} || {new} ELSE w END"


def porter_ctes(source: str, step2: dict[str, str], step3: dict[str, str], step4: list[str]) -> str:
    """`stems(token, stem)` for the distinct column `token` of `source`."""
    repaired = _case(
        [
            (_like("c", "(at|bl|iz)$"), "c || 'e'"),
            (_like("c", DOUBLE), _cut("c", 1)),
            (f"{_like('c', ME1)} AND {_like('c', SHORT)}", "c || 'e'"),
        ],
        "c",
    )
    found4 = "regexp_extract(w, '(" + "|".join(step4) + ")$', 1)"
    stem4 = _cut("w", f"length({found4})")
    text = [f"stem_words AS (SELECT DISTINCT token FROM {source})"]
    mark = "regexp_replace(regexp_replace(token, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    text.append(f"p0 AS (SELECT token, {mark} AS w FROM stem_words)")
    plural = _case([(_like("w", "(sses|ies)$"), _cut("w", 2)), (_like("w", "[^s]s$"), _cut("w", 1))], "w")
    text.append(f"p1 AS (SELECT token, {plural} AS w FROM p0)")
    cut = _case(
        [
            (_like("w", "eed$"), "NULL"),
            (_like("w", V + ".*ed$"), _cut("w", 2)),
            (_like("w", V + ".*ing$"), _cut("w", 3)),
        ],
        "NULL",
    )
    text.append(f"p1c AS (SELECT token, w, {cut} AS c FROM p1)")
    eed = f"CASE WHEN {_like('w', 'eed$')} AND {_like(_cut('w', 3), M0)} THEN {_cut('w', 1)} ELSE w END"
    text.append(f"p1b AS (SELECT token, CASE WHEN c IS NULL THEN {eed} ELSE {repaired} END AS w FROM p1c)")
    y = f"CASE WHEN {_like('w', V + '.*[yY]$')} THEN {_cut('w', 1)} || 'i' ELSE w END"
    text.append(f"p1y AS (SELECT token, {y} AS w FROM p1b)")
    text.append(f"p2 AS (SELECT token, {_suffix_step(step2)} AS w FROM p1y)")
    text.append(f"p3 AS (SELECT token, {_suffix_step(step3)} AS w FROM p2)")
    keep4 = f"{found4} = '' OR NOT {_like(stem4, M1)} OR ({found4} = 'ion' AND NOT {_like(stem4, '[st]$')})"
    text.append(f"p4 AS (SELECT token, CASE WHEN {keep4} THEN w ELSE {stem4} END AS w FROM p3)")
    s = _cut("w", 1)
    go = f"{_like('w', 'e$')} AND ({_like(s, M1)} OR ({_like(s, ME1)} AND NOT {_like(s, SHORT)}))"
    text.append(f"p5 AS (SELECT token, CASE WHEN {go} THEN {s} ELSE w END AS w FROM p4)")
    ll = f"CASE WHEN {_like('w', 'll$')} AND {_like('w', M1)} THEN {s} ELSE w END"
    text.append(
        f"stems AS (SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE lower({ll}) END AS stem FROM p5)"
    )
    return ",\n".join(text)
