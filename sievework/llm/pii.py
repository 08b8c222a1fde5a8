"""Personal data by fixed patterns and by bootstrapped contextual extraction (DataFrame functions only).

The fixed patterns find the seeds. Seeds induce lexical patterns of the slots they stand in: a label before the slot
(a word that ends in a colon or an equals sign), the two words before it, or the words on either side; a single plain
word is never a pattern. Patterns and the values in their slots form a graph that Spark scores in rounds, until no
value is new: a pattern is trusted if most different values in its slot are known, and a value becomes known if
trusted patterns vouch for it. Only words with the shape of a kind (`SHAPES`) can become known, and only as that kind;
all words of a slot count against its pattern. Known values are found wherever they stand. The spans of the fixed
patterns always stay, and found spans never overlap them.

Texts are never shuffled. One narrow pass lists the words that have the shape of any kind (candidates). A round reads
the texts once more, if patterns are newly supported, to count the different words in their slots: first by a sketch
of fixed size for each pattern; the words themselves are listed only for patterns whose known values could make up
the share, so that what is listed is bounded by what is known. All else runs on tables of seeds and candidates.

Defined results: a null text is an empty one; a null doc_id is kept as null; equal rows each get their own equal
result; an empty table gives an empty result; other columns are ignored, whatever their names; of patterns that vouch
equally for two kinds the later kind wins. A very long text costs time and memory in proportion to its length and to
the places found in it; values with a blank in them are found by the fixed patterns only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, durable, let, lookup, row_id

#: The four base kinds in the order of the contract. Leftmost, non-overlapping, as the plain patterns match; the
#: possessive forms and look-behinds only keep Java's matcher linear on very long runs.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can hold the kind at all.
_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BLOCK = 128
BROADCAST = 200_000
CONTEXT = 64
#: Patterns whose slots one pass over the texts counts.
PASS_PATTERNS = 500_000
#: Words before slots that a pass holds as literals (more are joined), and up to which it looks for texts with any of
#: them before it takes texts apart.
FEW, SOUGHT = 5_000, 32
RSD, MARGIN = 0.02, 0.9

_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
_AT, _DOT = r"(?:@|[(\[{<]at[)\]}>]|_at_)", r"(?:\.|[(\[{<]dot[)\]}>])"
_BYTE, _BETWEEN = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})", r"(?:\.|-|_|\[\.\]|\(\.\))"
#: What a found value of each kind must look like, in lower case and from end to end. Repeated groups are possessive or
#: bounded: Java's matcher goes one call deeper for each repeat of any other.
SHAPES = {
    "email": rf"^[\p{{L}}\p{{M}}\p{{N}}._%+-]+{_AT}[\p{{L}}\p{{M}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{M}}\p{{N}}-]++)++$",
    "ip": rf"^(?:{_BYTE}(?:{_BETWEEN}{_BYTE}){{3}}|[0-9a-f]{{1,4}}(?:::?[0-9a-f]{{1,4}}){{3,7}})$",
    "card": r"^(?=(?:[^0-9]*[0-9]){13,19}[^0-9]*$)[0-9](?:[._/-]?[0-9])++$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[+(]{0,2}[0-9](?:[.()/_-]{0,2}[0-9])++$",
}
#: Words that may have one of the shapes. Look-behinds keep the matcher from starting inside a word.
CANDIDATE = (
    rf"(?i)(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)++"
    r"|(?<![\p{L}\p{N}:])[0-9a-f]{1,4}(?:::?[0-9a-f]{1,4}){3,7}(?![\p{L}\p{N}:])"
    r"|(?<![\p{L}\p{N}._:/+(\[-])[+(]{0,2}[0-9](?:[.()\[\]/_-]{0,3}[0-9])++"
)
_GATES = r"(?i)[0-9][^\x20\x09-\x0D]*[0-9]|@|[(\[{<_]at[)\]}>_]"
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.sequence(F.lit(0), n - 1), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def scan(values: Column, op: Callable[[Column, Column], Column], start: Column) -> Column:
    """Running results of ``op`` over an array of longs: element i covers values 0..i. Arrays grow by whole blocks, so
    long arrays are not copied at every step."""

    def one(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))

    def blocks(xs: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), F.array().cast("array<bigint>").alias("out")), one)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
        found = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), zero, block, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(xs) > 0, found).otherwise(F.array().cast("array<bigint>"))

    return let(values, blocks)


def occurrences(text: Column, kind: str, pattern: str, rank: int, keep: Callable[[Column], Column]) -> Column:
    """All matches that ``keep`` takes, with code point positions and contexts. Matches and the gaps between them
    alternate, so running sums of their lengths give the positions."""

    def places(both: Column) -> Column:
        ends = scan(F.transform(both["found"], lambda m, i: (F.length(F.get(both["gaps"], i)) + F.length(m)).cast("long")), lambda a, x: a + x, F.lit(0))
        return let(F.struct(both["found"].alias("found"), both["gaps"].alias("gaps"), ends.alias("ends")), spans)

    def spans(x: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            end = F.get(x["ends"], i)
            before = F.concat(F.when(i > 0, F.get(x["found"], i - 1)).otherwise(""), F.get(x["gaps"], i))
            return F.when(
                keep(m),
                F.struct(
                    (end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("value"),
                    F.substring(before, -CONTEXT, CONTEXT).alias("left"), F.substring(F.get(x["gaps"], i + 1), 1, CONTEXT).alias("right"),
                ),
            )

        return F.array_compact(F.transform(x["found"], span))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), places)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind as listed."""
    none = F.array().cast(_SPAN)
    each = [
        F.when(F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_GATE[kind]), occurrences(text, kind, pattern, rank, lambda m, k=kind: _valid(k, m))).otherwise(none)
        for rank, (kind, pattern) in enumerate(KINDS.items())
    ]
    return F.array_sort(F.concat(*each))


def _clear_of(spans: Column, base: Column) -> Column:
    """The spans that no base span overlaps. Both are put in one order; a running maximum of base ends and, from the
    back, a running minimum of base starts tell for each whether a base span reaches into it."""
    mark = lambda xs, own: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("s")))
    far = F.lit(1 << 60)

    def pick(xs: Column) -> Column:
        ends = scan(F.transform(xs, lambda x: F.when(x["own"], F.lit(-1)).otherwise(x["end"]).cast("long")), F.greatest, F.lit(-1))
        starts = F.reverse(scan(F.reverse(F.transform(xs, lambda x: F.when(x["own"], far).otherwise(x["start"]).cast("long"))), F.least, far))
        return let(F.struct(xs.alias("xs"), ends.alias("ends"), starts.alias("starts")), free)

    def free(b: Column) -> Column:
        own = F.transform(b["xs"], lambda x, i: F.when(x["own"] & (F.get(b["ends"], i) <= x["start"]) & (F.get(b["starts"], i) >= x["end"]), x["s"]))
        return F.array_compact(own)

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(mark(base, False), mark(spans, True))), pick)).otherwise(spans)


#: Punctuation around words: ASCII's but @ and +, the general and the CJK marks. A colon is treated by itself.
_MARK = r"[!-*,-/;-?\[-`{-~\u00A1\u00A7\u00AB\u00B6\u00B7\u00BB\u00BF\u2010-\u205E\u3000-\u3003\u3008-\u3011]"
_END = r"(?=[\x20\x09-\x0D]|$)"


def _plain(text: Column) -> Column:
    """Lower case; words lose the punctuation around them, but a label keeps one colon at its end. The look-behind
    after the first mark keeps the matcher from starting again within a long run of marks."""
    marked = F.regexp_replace(F.lower(text), rf"[:=](?<![:=][:=])[:=]*+{_END}", ":")
    bare = F.regexp_replace(marked, rf"{_MARK}(?<!{_MARK}{_MARK}){_MARK}*+{_END}", "")
    return F.regexp_replace(bare, rf"(^|[\x20\x09-\x0D]){_MARK}++", "$1")


def _plain_words(text: Column) -> Column:
    return F.array_remove(F.split(_plain(text), SPACE), "")


def _value(word: Column) -> Column:
    return F.rtrim(word, F.lit(":"))


def _patterns(two: Column, one: Column, nxt: Column) -> Column:
    label = F.when(one.rlike(r"\p{L}.*:$"), F.concat(F.lit("L "), one))
    return F.array_compact(F.array(label, F.concat(F.lit("LL "), two, F.lit(" "), one), F.concat(F.lit("LR "), one, F.lit(" _ "), nxt)))


def _span_patterns(left: Column, right: Column) -> Column:
    one = lambda ws: F.struct(F.try_element_at(ws, F.lit(-2)).alias("two"), F.try_element_at(ws, F.lit(-1)).alias("one"))
    nxt = _value(F.get(_plain_words(right), F.lit(0)))
    return let(let(_plain_words(left), one), lambda w: _patterns(w["two"], w["one"], nxt))


def _slots(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, word) of every word in a slot of ``patterns``, of which there are at most `PASS_PATTERNS`. Words whose
    predecessor begins no pattern are passed over: inside the text for a few predecessors, by a join for many."""
    parts = F.split("pattern", " ", -1)
    ones = patterns.select(F.get(parts, F.when(F.get(parts, F.lit(0)) == "LL", 2).otherwise(1)).alias("one")).distinct()
    few = [r["one"] for r in ones.limit(FEW + 1).collect()]
    some = (lambda w: w.isin(few)) if len(few) <= FEW else (lambda w: F.lit(True))

    def around(ws: Column) -> Column:
        after = F.filter(F.transform(ws, lambda w, i: F.when(some(w), i)), lambda i: i.isNotNull())
        return F.transform(after, lambda i: F.struct(F.get(ws, i - 1).alias("two"), F.get(ws, i).alias("one"), _value(F.get(ws, i + 1)).alias("word"), _value(F.get(ws, i + 2)).alias("nxt")))

    if len(few) <= SOUGHT:
        texts = texts.where(reduce(or_, [F.contains(F.lower("text"), F.lit(w.rstrip(":"))) for w in few], F.lit(False)))
    near = texts.select(F.inline(let(_plain_words(F.col("text")), around))).where("word IS NOT NULL")
    if len(few) > FEW:
        near = near.join(F.broadcast(ones), "one", "left_semi")
    pairs = near.select(F.explode(_patterns(F.col("two"), F.col("one"), F.col("nxt"))).alias("pattern"), "word")
    return pairs.join(F.broadcast(patterns.select("pattern")), "pattern", "left_semi")


def _in_passes(patterns: DataFrame, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` applied to parts of ``patterns`` of bounded size, one pass over the texts each."""
    parts = max(1, -(-patterns.count() // PASS_PATTERNS))
    out = None
    for k in range(parts):
        got = durable(use(patterns if parts == 1 else patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)), "pii-slots")
        out = got if out is None else out.unionByName(got)
    return out


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _fits(kind: Column, value: Column) -> Column:
    out = F.lit(False)
    for k, shape in SHAPES.items():
        out = out | ((kind == k) & value.rlike(shape))
    return out


def bootstrap(rows: DataFrame, seeds: DataFrame, min_support: int, min_confidence: float, min_score: float) -> DataFrame | None:
    """Places (rid, start, end, value, kind) of newly known values, None without any. ``rows``: rid, text, base.
    ``seeds``: distinct (pattern, value, kind) of the fixed spans."""
    text = F.col("text")
    keep = lambda m: let(F.lower(m), lambda v: F.exists(F.array(*map(F.lit, SHAPES.values())), lambda p: F.rlike(v, p)))
    worth = occurrences(text, "", CANDIDATE, len(KINDS), keep)
    spans = F.when(text.rlike(_GATES), _clear_of(worth, F.col("base"))).otherwise(F.array().cast(_SPAN))
    seen = rows.select("rid", F.explode(spans).alias("s")).select("rid", "s.start", "s.end", F.lower("s.value").alias("value"), _span_patterns(F.col("s.left"), F.col("s.right")).alias("patterns"))
    places = durable(seen.distinct(), "pii-candidates")
    offers = durable(places.select("value", F.explode("patterns").alias("pattern")).distinct(), "pii-offers")
    if offers.isEmpty():
        return None
    found = durable(seeds.select("value", "kind").limit(0), "pii-found")
    rough, exact, size = None, None, 0
    while True:
        edges = durable(seeds.unionByName(offers.join(found, "value")).groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
        known = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("f")).groupBy("pattern").agg(F.max(F.struct("f", "kind")).alias("best"))
        known = durable(known.select("pattern", F.col("best.kind").alias("as_kind"), F.col("best.f").alias("f")).where(F.col("f") >= min_support), "pii-known")
        # a pattern matters only where it offers a word that is not known yet
        todo = known.join(offers.join(found, "value", "left_anti").select("pattern").distinct(), "pattern", "left_semi")
        fresh = durable(todo if rough is None else todo.join(rough, "pattern", "left_anti"), "pii-patterns")
        if not fresh.isEmpty():
            count = lambda part: _slots(rows, part).groupBy("pattern").agg(F.approx_count_distinct("word", RSD).alias("about"))
            counted = _in_passes(fresh, count)
            rough = counted if rough is None else rough.unionByName(counted)
        if rough is None:
            return None
        near = known.join(rough, "pattern").where(F.col("f") >= min_confidence * MARGIN * F.col("about"))
        near = durable(near if exact is None else near.join(exact.select("pattern").distinct(), "pattern", "left_anti"), "pii-near")
        if not near.isEmpty():
            words = _in_passes(near, lambda part: _slots(rows, part).distinct())
            # a pattern without any word keeps a row, so that it is not listed again
            words = words.unionByName(near.select("pattern", F.lit("").alias("word")))
            exact = words if exact is None else exact.unionByName(words)
        if exact is None:
            return None
        firsts = edges.select("pattern", F.coalesce(_value(F.get(_plain_words(F.col("value")), F.lit(0))), F.lit("")).alias("word")).distinct()
        others = exact.where("word <> ''").join(firsts, ["pattern", "word"], "left_anti").groupBy("pattern").agg(F.count(F.lit(1)).alias("others"))
        trust = known.join(exact.select("pattern").distinct(), "pattern", "left_semi").join(others, "pattern", "left")
        trust = trust.select("pattern", "as_kind", (F.col("f") / (F.col("f") + F.coalesce("others", F.lit(0)))).alias("confidence")).where(F.col("confidence") >= min_confidence)
        trust = durable(trust, "pii-trust")
        new = lookup(offers.join(found, "value", "left_anti"), trust, ["pattern"], F.col("value"), BROADCAST).where(_fits(F.col("as_kind"), F.col("value")))
        new = (
            new.groupBy("value", "as_kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("score"))
            .groupBy("value").agg(F.max(F.struct("score", "as_kind")).alias("top"))
            .where(F.col("top.score") >= min_score).select("value", F.col("top.as_kind").alias("kind"))
        )
        found = durable(found.unionByName(new), "pii-found")
        now = found.count()
        if now == size:
            break
        size = now
    if not size:
        return None
    return lookup(places.select("rid", "start", "end", "value"), found, ["value"], F.col("rid"), BROADCAST)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 3, min_confidence: float = 0.5, min_score: float = 0.6) -> DataFrame:
    """One row per document: doc_id, base and found spans (arrays of start, rank, kind, end, value, ...).

    min_support: different known values that a pattern must surround; min_confidence: their share of all values in
    its slot; min_score: the probability, by noisy-or over trusted patterns, from which a value becomes known."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(id_col), F.col(text_col)).alias("rid"), text.alias("text"))
    rows = durable(rows.select("doc_id", "rid", "text", base_spans(F.col("text")).alias("base")), "pii-spans")
    seeds = rows.select(F.explode("base").alias("s")).select(_value(_plain(F.col("s.value"))).alias("value"), F.col("s.kind").alias("kind"), F.explode(_span_patterns(F.col("s.left"), F.col("s.right"))).alias("pattern"))
    seeds = durable(seeds.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-seeds")
    places = bootstrap(rows, seeds, min_support, min_confidence, min_score)
    none = F.array().cast(_SPAN)
    if places is None:
        return rows.select("doc_id", "base", none.alias("found"))
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "kind", "end", "value", F.lit("").alias("left"), F.lit("").alias("right"))
    found = places.groupBy("rid").agg(F.array_sort(F.collect_set(span)).alias("found"))
    return rows.select("doc_id", "rid", "base").join(found, "rid", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))
