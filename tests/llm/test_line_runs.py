"""Runs of repeated units against a brute-force version: wrapped, mixed and inserted passages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultsift.llm import line_hashing

PATTERNS = {"sentence": line_hashing.UNITS["sentence"], "line": line_hashing.UNITS["line"], "paragraph": r"(?s)(?:.(?!\n\n))*(?:.\n\n)|\n\n|.+"}


def sentences(rng, n):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) + rng.choice(".!?") for _ in range(n)]


def brute(docs, kind, floor):
    """{(key, text): {(unit_no, start, stop, first_key, first_unit_no)}} of the units to remove."""
    cut = {}
    for key, text in dict.fromkeys(docs):
        found = [m for m in re.finditer(PATTERNS[kind], text or "")]
        cut[key, text] = [(i, m.start(), m.end(), m.group().lower().encode().split()) for i, m in enumerate(found)]
    first, out = {}, {}
    for key, text in sorted(cut, key=lambda d: (d[0] is None, d[0] or 0)):
        for number, _, _, words in cut[key, text]:
            first.setdefault(b" ".join(words), (key, number, text))
    for (key, text), found in cut.items():
        run, gone = [], set()
        for number, start, stop, words in [u for u in found if u[3]] + [(None, 0, 0, [b"end"])]:
            origin = first.get(b" ".join(words))
            if number is None or origin == (key, number, text):
                if sum(n for *_, n in run) >= floor:
                    gone |= {r[:5] for r in run}
                run = []
            else:
                run.append((number, start, stop, *origin[:2], len(words)))
        out[key, text] = gone
    return out


@pytest.mark.parametrize("kind", ["sentence", "line", "paragraph"])
def test_runs_against_brute_force(spark, kind):
    rng = random.Random(len(kind))
    shared = [sentences(rng, 9) for _ in range(3)]
    docs = []
    for key in range(30):
        pieces = sentences(rng, rng.randint(0, 8))
        for passage in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(pieces))
            pieces[at:at] = passage
        text = "".join(p + rng.choice([" ", "\n", "\n\n", "\n \n"] if kind != "paragraph" else ["\n\n", "\n"]) for p in pieces)
        docs.append((key, text if key % 3 else text.upper()))
    docs += [docs[4], docs[4], (None, docs[7][1]), (90, None), (91, ""), (92, " \n\n.\n"), (93, "é x. " * 4000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    table = table.withColumns({"copy": F.lit("x"), "unit": F.lit(1), "removed_spans": F.lit("old"), "_k": F.lit(0)})
    want = brute(docs, kind, 25)
    found = {}
    for r in line_hashing.repeats(table, kind=kind).collect():
        found.setdefault((r.doc_id, r.copy), set()).add((r.unit_no, r.start, r.stop, r.first_key, r.first_unit_no))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if v)
    assert sum(map(len, want.values())) > 20
    cleaned = line_hashing.deduplicated(table, kind=kind)
    assert cleaned.columns == ["doc_id", "text", "copy", "unit", "_k", "removed_spans"]
    for r in cleaned.select("doc_id", "text", "removed_spans").collect():
        texts = [t for k, t in want if k == r.doc_id]
        kept = [
            (t and "".join(c for i, c in enumerate(t) if not any(a <= i < b for _, a, b, *_ in want[r.doc_id, t])), sorted((a, b) for _, a, b, *_ in want[r.doc_id, t]))
            for t in texts
        ]
        assert (r.text, [tuple(s) for s in r.removed_spans]) in kept


def test_a_passage_wrapped_or_inside_a_line_goes(spark):
    rng = random.Random(5)
    passage = sentences(rng, 12)
    own = [sentences(rng, 3) for _ in range(3)]
    docs = [(0, " ".join(own[0] + passage)), (1, "\n".join(own[1] + passage)), (2, " ".join(own[2][:1] + passage + own[2][1:])), (3, "ab. cd.")]
    cleaned = {r.doc_id: r.text for r in line_hashing.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert cleaned[0] == docs[0][1] and cleaned[3] == "ab. cd."
    assert cleaned[1] == "\n".join(own[1]) + "\n" and cleaned[2] == " ".join(own[2])


def test_what_a_packing_task_kept_goes_with_it(spark):
    import public_tokenizers

    from faultsift.llm import common, packing

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.WordEncoder(path)
    whole = ["Plain words, é and " + "x" * 70, "again"]
    first = list(encoder.encode(whole))
    assert encoder.parts and "x" * 70 not in encoder.parts and encoder.atoms
    encoder.forget()
    assert not encoder.parts and not encoder.atoms and list(encoder.encode(whole)) == first
    held = spark.createDataFrame([(i, f"w{i} " * 50) for i in range(40)], "doc_id long, text string").repartition(1)
    packing.pieces(held, path).count()
    left = spark.range(1, numPartitions=1).mapInPandas(
        lambda frames: (f.assign(n=sum(len(e.parts) + len(e.parts.older) for e in packing._ENCODERS.values())) for f in frames), "id long, n long"
    )
    assert left.first()["n"] == 0
    assert common.LookupCache(str.encode, 5)["a"] == b"a"
