"""Personal data by bootstrapped contextual extraction (operator 9), in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import bounded, digest
from faultsift.session import stage, unstage

KINDS = ("email", "ip", "card", "phone")
#: What the base rules take, each written so that a search is linear in the text: a run starts
#: where the class starts (or where the last match ended) and is never given back.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens with digits, colons or an at-sign that are identifiers only in a context that says so: 7 to
#: 15 digits or 13 to 19 with a right check digit, however they are separated; hexadecimal groups with
#: two colons or more; an at-sign, also a written one, between a name and a host. A run of digits is
#: taken whole or not at all.
_GAP, _CARD_GAP = r"[ ()./-]", "[ ._/-]"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:@| ?[\[(](?:at|AT)[\])] ?){_LABEL}++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?){_LABEL}++)*+",
    "ip": r"(?<![0-9A-Za-z:])(?=:{0,2}[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "card": rf"(?<![0-9A-Za-z])(?<![0-9]{_CARD_GAP})[0-9](?:{_CARD_GAP}?[0-9]){{12,18}}(?!{_CARD_GAP}?[0-9])(?![A-Za-z])",
    "phone": rf"(?<![0-9A-Za-z+(])(?<![0-9]{_GAP}{{1,2}})\(?[0-9](?:{_GAP}{{0,2}}[0-9]){{6,14}}(?!{_GAP}{{0,2}}[0-9])(?![A-Za-z])",
}
#: What a text has that holds one of them.
_HINT = r"@|[\[(](?:at|AT)[\])]|[0-9](?:[ ()._/-]{0,2}[0-9]){6}|:[0-9A-Fa-f]{0,4}:"
#: Characters before and behind an identifier that its contexts are read from.
BEFORE, BEHIND = 120, 60
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Distinct base identifiers that a context needs, and the confidence from which on a context or
#: an identifier counts.
LEAST_SEEDS, CONFIDENCE = 3, 0.8
ROUNDS = 3
MARK, OTHER = "\x01", "\x02"


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of at most 19 digits is right."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The condition that a match must pass."""
    if kind == "ip":
        return s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.char_length(_digits(s))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(s)))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each, by blocks so that very many cost little more than few."""

    def by_block(lens: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(lens))).cast("int")

        def within(block: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.size(block) - 1), lambda i: F.aggregate(F.slice(block, 1, i), F.lit(0), lambda a, b: a + b))
            return F.struct(sums.alias("sums"), F.aggregate(block, F.lit(0), lambda a, b: a + b).alias("total"))

        cut = F.transform(F.sequence(F.lit(0), F.size(lens) - 1, size), lambda at: within(F.slice(lens, at + 1, size)))

        def shifted(blocks: Column) -> Column:
            return F.flatten(
                F.transform(
                    blocks,
                    lambda b, i: _let(
                        F.aggregate(F.slice(blocks, 1, i), F.lit(0), lambda a, x: a + x["total"]),
                        lambda before: F.transform(b["sums"], lambda s: s + before),
                    ),
                )
            )

        return _let(cut, shifted)

    return _let(lengths, by_block)


_SPANS = "array<struct<kind:string,start:int,stop:int,value:string,left:string,right:string>>"


def _whole_words(part: Column, before: bool) -> Column:
    """What stands next to an identifier in `part`, without the word that the length of it cuts."""
    most, near, cut = (BEFORE, F.right, r"^\S+") if before else (BEHIND, F.left, r"\S+$")
    return F.when(F.char_length(part) <= most, part).otherwise(F.regexp_replace(near(part, F.lit(most)), cut, ""))


def _blocks(spans: Column) -> Column:
    """Spans in blocks with the range they cover, so that looking for what meets a span opens few."""
    size = F.ceil(F.sqrt(F.size(spans))).cast("int")

    def block(some: Column) -> Column:
        return F.struct(
            F.array_min(F.transform(some, lambda s: s["start"])).alias("start"),
            F.array_max(F.transform(some, lambda s: s["stop"])).alias("stop"),
            some.alias("spans"),
        )

    cut = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, size), lambda at: _let(F.slice(spans, at + 1, size), block))
    return F.when(F.size(spans) > 0, cut).otherwise(F.array().cast(f"array<struct<start:int,stop:int,spans:{_SPANS}>>"))


def _matches(text: Column, kind: str, pattern: str, test) -> Column:
    """kind, start, stop, value and the characters around of every match that passes `test`."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}")
    none = F.array().cast(_SPANS)

    def one(parts: Column, starts: Column, i: Column) -> Column:
        value = F.get(parts, i)
        return F.struct(
            F.lit(kind).alias("kind"),
            F.get(starts, i).alias("start"),
            (F.get(starts, i) + F.char_length(value)).alias("stop"),
            value.alias("value"),
            _whole_words(F.get(parts, i - 1), before=True).alias("left"),
            _whole_words(F.get(parts, i + 1), before=False).alias("right"),
        )

    def spans(parts: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        lengths = F.transform(parts, lambda x: F.char_length(x))
        found = _let(_starts(lengths), lambda starts: F.transform(at, lambda i: one(parts, starts, i)))
        return F.when(F.size(parts) < 3, none).otherwise(F.filter(found, lambda m: test(m["value"])).cast(_SPANS))

    return _let(F.split(marked, MARK, -1), spans)


def found_spans(text: Column) -> Column:
    """Struct of `base`, all base spans by kind as listed and start, and `loose`, candidates off them."""
    plain = F.coalesce(text, F.lit(""))
    none, digit = F.array().cast(_SPANS), plain.rlike("[0-9]")
    needs = {"email": plain.contains("@"), "ip": digit, "card": digit, "phone": plain.contains("+")}
    hint = plain.rlike(_HINT)
    base = [F.when(needs[k], _matches(plain, k, BASE[k], lambda v, k=k: valid(k, v))).otherwise(none) for k in KINDS]
    right = {"card": lambda v: luhn(_digits(v))}
    loose = [F.when(hint, _matches(plain, k, LOOSE[k], right.get(k, lambda v: F.lit(True)))).otherwise(none) for k in KINDS]

    def apart(spans: Column) -> Column:
        meet = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
        free = lambda blocks: F.filter(
            F.concat(*loose), lambda c: ~F.exists(blocks, lambda b: meet(b, c) & F.exists(b["spans"], lambda s: meet(s, c)))
        )
        return F.struct(spans.alias("base"), _let(_blocks(spans), free).alias("loose"))

    return _let(F.concat(*base), apart)


def _contexts(span: Column) -> Column:
    """The lexical patterns around an identifier: two words before it; the words before and behind it.

    A word that does not fit into BEFORE or BEHIND characters is no part of a pattern.
    """
    before = F.split(F.trim(F.regexp_replace(F.lower(span["left"]), r"\s+", " ")), " ")
    behind = F.get(F.split(F.trim(F.regexp_replace(F.lower(span["right"]), r"\s+", " ")), " "), F.lit(0))
    plain = lambda c: F.regexp_replace(c, "[0-9]", "0")
    last, other = F.get(before, F.size(before) - 1), F.get(before, F.size(before) - 2)
    two = F.when((last != "") & (other != ""), plain(F.concat_ws(" ", other, last)))
    around = F.when((last != "") & (behind != ""), plain(F.concat_ws(" _ ", last, behind)))
    return F.filter(F.array(two, around), lambda c: c.isNotNull())


def _instance(kind: Column, value: Column) -> Column:
    """One form for all ways to write an identifier."""
    return F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.regexp_replace(F.lower(value), r"\s", ""))


def accepted(found: DataFrame) -> DataFrame:
    """(kind, instance) of the loose candidates that high-confidence contexts identify.

    The base identifiers of `found` (arrays base and loose) are the first seeds. A pattern is a kind
    and a context; it takes part with LEAST_SEEDS distinct seeds. Rounds over the graph of patterns
    and candidates: the confidence of a pattern is the mean score of its distinct instances, where
    a seed scores 1; the score of a candidate is the chance that not all of its patterns err. What
    is accepted joins the seeds and patterns are counted anew, until nothing new is accepted. All
    of it is grouped sums and joins of distinct pairs, whatever the frequency of a pattern.
    """
    opened = [
        found.select(F.explode(column).alias("s"), F.lit(seed).alias("seed")).select(
            "s.kind", _instance(F.col("s.kind"), F.col("s.value")).alias("instance"), F.explode(_contexts(F.col("s"))).alias("context"), "seed"
        )
        for column, seed in (("base", 1), ("loose", 0))
    ]
    pairs = opened[0].unionByName(opened[1]).groupBy("kind", "context", "instance").agg(F.max("seed").alias("seed"))
    pairs = stage(pairs, "pairs")
    fine = None
    while True:
        new = stage(_accepted_by(pairs), "accepted")
        if new.isEmpty():
            break
        fine = new if fine is None else fine.unionByName(new)
        more = pairs.join(bounded(new.withColumn("new", F.lit(1))), ["kind", "instance"], "left")
        seeded = stage(more.select("kind", "context", "instance", F.coalesce("new", "seed").alias("seed")), "pairs")
        unstage(pairs)
        pairs = seeded
    unstage(pairs)
    return new if fine is None else fine


def _accepted_by(pairs: DataFrame) -> DataFrame:
    """(kind, instance) of the candidates, no seeds yet, that the seeds of `pairs` identify."""
    patterns = pairs.groupBy("kind", "context").agg(F.sum("seed").alias("seeds"), F.count("*").alias("n"))
    patterns = patterns.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("n") > F.col("seeds")))
    graph = stage(pairs.where("seed = 0").drop("seed").join(patterns, ["kind", "context"]), "graph")
    confidence = graph.select("kind", "context", (F.col("seeds") / F.col("n")).alias("c")).distinct()
    scores = None
    for _ in range(ROUNDS):
        errs = F.exp(F.sum(F.log(1 - F.least("c", F.lit(0.999999)))))
        after = graph.join(confidence, ["kind", "context"]).groupBy("kind", "instance").agg((1 - errs).alias("score"))
        scores = stage(after, "scores")
        total = (F.first("seeds") + F.sum("score")) / F.first("n")
        confidence = graph.join(scores, ["kind", "instance"]).groupBy("kind", "context").agg(total.alias("c"))
    return scores.where(F.col("score") >= CONFIDENCE).select("kind", "instance")


_SHORT = "array<struct<kind:string,start:int,stop:int>>"


def _short(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def _added(found: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and `added`, the accepted candidates of every document that has some."""
    fine = stage(accepted(found), "accepted")
    opened = found.where(F.size("loose") > 0).select(*keys, F.explode("loose").alias("s"))
    opened = opened.select(*keys, "s.kind", "s.start", "s.stop", _instance(F.col("s.kind"), F.col("s.value")).alias("instance"))
    joined = opened.join(bounded(fine), ["kind", "instance"], "left_semi")
    return joined.groupBy(*keys).agg(F.collect_set(F.struct("kind", "start", "stop")).cast(_SHORT).alias("added"))


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start."""
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(F.element_at(number, s["kind"]).alias("no"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.sort_array(keyed)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the key, n_<kind> and base_sha256 of the base spans, n_added, and all spans.

    Spans count code points, end exclusive. A null text counts as empty; null keys and repeated
    rows get rows of their own. The texts are read once; what is found in them is stored.
    """
    plain = docs.select(F.col(f"`{key}`").alias("_k"), found_spans(F.col(f"`{text}`").cast("string")).alias("f"))
    found = plain.select(F.monotonically_increasing_id().alias("_row"), "_k", "f.base", "f.loose")
    found = stage(found, "spans")  # the row numbers stay as they are from here on
    joined = found.join(_added(found, ["_row"]), "_row", "left").withColumn("added", F.coalesce("added", F.array().cast(_SHORT)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        F.col("_k").alias(key),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(_ordered(F.concat(_short(F.col("base")), F.col("added")))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def masked(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in brackets.

    Overlapping spans become one, named after the first. Null texts stay null, extra columns stay.
    Base spans are found anew in the row; only the added ones, few, are joined by key and digest.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = F.col(names[text])
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keyed = plain.select(F.col(names[key]).alias("_k"), digest(own).alias("copy"), found_spans(own).alias("f"))
    found = stage(keyed.select("_k", "copy", "f.base", "f.loose").where("size(base) + size(loose) > 0"), "spans")
    added = stage(_added(found, ["_k", "copy"]), "added")
    unstage(found)
    mine = F.col(names[key]).eqNullSafe(F.col("_k")) & (digest(own) == F.col("copy"))
    joined = plain.withColumn("_f", found_spans(own)).join(bounded(added), mine, "left")
    joined = joined.withColumn("added", F.coalesce("added", F.array().cast(_SHORT)))

    def cut(spans: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, s: Column) -> Column:
            before = F.substring(own, state["at"] + 1, s["start"] - state["at"])
            more = F.concat(state["out"], F.array(before, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
            out = F.when(s["start"] >= state["at"], more).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), out.alias("out"))

        rest = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(own, state["at"] + 1, F.char_length(own)))
        return F.aggregate(spans, first, step, rest)

    places = F.concat(_short(F.col("_f.base")), F.col("added"))
    ordered = F.sort_array(F.transform(places, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("no"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    changed = F.when((F.size("_f.base") + F.size("added")) == 0, own).otherwise(cut(ordered))
    return joined.select(*[(changed if c == text else F.col(n)).alias(c) for c, n in names.items()])
