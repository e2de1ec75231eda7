"""Secret scans with DataFrame functions only: patterns plus two character Markov models.

Two first-order chains over ``ALPHABET``, of random strings and of ordinary
identifiers, are counted from labelled samples that are themselves made with
Spark functions; the ordinary ones join parts of identifiers and words of real
text (:func:`corpus_words`). In a run of the alphabet the stretch of the
greatest log-likelihood ratio is sought and widened to the run's next ``/ _ = -``
on either side, and over words of ``PREFIX`` characters at most: it is a secret if the ratio passes the threshold. The table of
ratios has ``(len(ALPHABET) + 1) ** 2`` cells, whatever the corpus, and travels
inside the plan as one literal.

Spans are in code points, end exclusive. Pattern spans always stay; model spans
are sought in what they leave of the text.

Cases: null texts count as empty and have no spans; texts are scanned whole,
whatever their length; ids are only carried, so nulls and repeats are allowed;
an empty table gives no rows, and without samples every ratio is 0, so the
patterns stand alone; further columns are carried unless they are called
``secrets``, which :func:`find_secrets` sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: What the models are asked about: runs of the alphabet of at least so many characters.
MIN_RANDOM = 16
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}"
#: Characters that part a run into words.
SEPARATORS = "/_=-"
#: Words of a run that go with a random stretch beside them if they are no longer than this, such as a key's prefix.
PREFIX = 4
#: Labelled strings of each class, and the share of ordinary ones that may score above the threshold.
SAMPLES, FALSE_SHARE = 6000, 0.0005
#: Words of real text that ordinary samples may use, at most.
CORPUS_WORDS = 3000
#: Least threshold, in nats.
MARGIN = 3.0

#: Parts of ordinary identifiers and prose (fixed values).
PARTS = (
    "get set is has new old user name id key value list map index count size total first last next "
    "file path dir line text word data table row column field type class object item node edge tree "
    "read write open close start stop begin end create delete update insert select filter sort group "
    "load save parse format print error warning debug info message request response server client "
    "config option default test check valid result input output buffer stream string number date time "
    "time zone day month year http https www com org net html css json xml api version build release "
    "the and for with from that this there where which have been were will would could should about "
    "tion ing ment ness able ally ation ering ough ight ound ther here ould ense ance ence ious "
    "der die und ein ich nicht ung heit keit schaft lich les des dans pour avec sur est une que por "
    "para los las del con una como mente cion ado ido"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def running_sum(values: Column) -> Column:
    """Sums of all elements before each element of an array, by blocks of 128: near-linear in its length."""
    add = lambda a, x: a + x
    part = lambda b: F.aggregate(F.slice(values, b * 128 + 1, 128), F.lit(0), add)
    blocks = F.shiftright(F.size(values) + 127, 7)
    indexes = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))

    def whole(sums: Column) -> Column:
        before = F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, 1, b), F.lit(0), add))
        inside = lambda i: F.aggregate(F.slice(values, F.shiftright(i, 7) * 128 + 1, i.bitwiseAND(127)), F.lit(0), add)
        return let(before, lambda t: F.transform(values, lambda _, i: t[F.shiftright(i, 7)] + inside(i)))

    return let(F.transform(indexes, part), whole)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start int, end int, said string>>`` of the leftmost matches that do not overlap.

    ``said`` is the group's text. Positions are sums of the lengths of the
    matches and of the gaps between them.
    """
    empty = F.array().cast("array<struct<start:int,end:int,said:string>>")
    rx = F.lit(pattern)
    found = F.struct(
        F.transform(F.regexp_extract_all(text, rx, F.lit(0)), F.length).alias("long"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, rx, F.lit(group)).alias("said"),
    )

    def place(f: Column) -> Column:
        steps = F.transform(f["long"], lambda n, i: n + f["gap"][i])
        return let(
            let(steps, running_sum),
            lambda before: F.transform(
                f["long"],
                lambda n, i: F.struct(
                    (before[i] + f["gap"][i]).cast("int").alias("start"), (before[i] + f["gap"][i] + n).cast("int").alias("end"), f["said"][i].alias("said")
                ),
            ),
        )

    return F.when(text.rlike(pattern), let(found, place)).otherwise(empty)


def _as_spans(found: Column, kind: str) -> Column:
    at = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(at).alias("rank"), m["end"].alias("end")))


def corpus_words(texts: DataFrame, text_column: str = "text", limit: int = CORPUS_WORDS) -> list[str]:
    """At most ``limit`` distinct words of 2 to 14 letters a-z of a text column, the first by a hash."""
    word = F.explode(F.regexp_extract_all(text_or_empty(text_column), F.lit(r"\b[a-z]{2,14}\b"), F.lit(0))).alias("word")
    return [r["word"] for r in texts.select(word).distinct().orderBy(F.xxhash64("word"), "word").limit(limit).collect()]


def labelled_samples(spark: SparkSession, n: int = SAMPLES, words: Sequence[str] = (), first: int = 0) -> DataFrame:
    """``(random boolean, said string)``, ``n`` of each: digests in usual encodings, and parts or ``words`` joined in usual ways."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    bytes_ = F.unhex(digest)
    upper = F.upper(F.translate(F.base64(bytes_), "+/=abcdefghij", "XYZKLMNOPQRST"))
    noise = F.substring(F.element_at(F.array(digest, F.base64(bytes_), F.translate(F.base64(bytes_), "+/=", "-_"), upper), (i % 4 + 1).cast("int")), F.lit(1), (20 + i % 24).cast("int"))
    # every other sample is made of words of text, if there are any
    tables = [F.split(F.lit(" ".join(t)), " ") for t in (PARTS, tuple(words) or PARTS)]
    parts = F.when(F.pmod(F.shiftright(F.xxhash64(i), 7), F.lit(2)) == 0, tables[0]).otherwise(tables[1])
    words = let(parts, lambda t: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: t[F.pmod(F.xxhash64(i, k), F.size(t)).cast("int")]))
    plain = F.element_at(
        F.array(
            F.array_join(words, "_"),
            F.array_join(F.transform(words, F.initcap), ""),
            F.array_join(words, "-"),
            F.array_join(words, ""),
            F.array_join(words, "/"),
            F.upper(F.array_join(words, "_")),
            F.concat(F.array_join(words, "_"), F.lit("_"), (i % 100).cast("string")),
            F.array_join(words, ""),
            F.upper(F.array_join(words, "")),
            F.repeat(F.substring(F.lit(ALPHABET), (i % 67 + 1).cast("int"), F.lit(1)), 30),
        ),
        (i % 10 + 1).cast("int"),
    )
    base = spark.range(first, first + n, 1, 4)
    return base.select(F.lit(True).alias("random"), noise.alias("said")).union(base.select(F.lit(False).alias("random"), plain.alias("said")))


def _codes(said: Column) -> Column:
    """Places of the characters in the alphabet, from 1; 0 stands before the first."""
    return F.transform(F.split(said, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _cells(said: Column) -> Column:
    width = len(ALPHABET) + 1
    return let(F.filter(_codes(said), lambda c: c > 0), lambda c: F.transform(c, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(c[i - 1]) * width + x))


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios by cell, and the score above which a string counts as random."""

    ratios: tuple[float, ...]
    threshold: float

    def stretch(self, said: Column) -> Column:
        """``struct<score, start, end>``: the stretch of a string with the greatest sum of ratios, in nats, widened to separators."""
        table = F.split(F.lit(",".join(f"{r:.3f}" for r in self.ratios)), ",").cast("array<double>")
        none = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("end"))

        def step(acc: Column, cell: Column) -> Column:
            on = acc["sum"] > 0
            total = F.get(table, cell) + F.when(on, acc["sum"]).otherwise(0.0)
            return let(
                F.struct(total.alias("t"), F.when(on, acc["from"]).otherwise(acc["at"]).alias("f")),
                lambda n: F.struct(
                    n["t"].alias("sum"),
                    n["f"].alias("from"),
                    (acc["at"] + 1).alias("at"),
                    F.greatest(n["t"], acc["score"]).alias("score"),
                    F.when(n["t"] > acc["score"], n["f"]).otherwise(acc["start"]).alias("start"),
                    F.when(n["t"] > acc["score"], acc["at"] + 1).otherwise(acc["end"]).alias("end"),
                ),
            )

        def widen(acc: Column) -> Column:
            some, sep = f"[^{SEPARATORS}]", f"[{SEPARATORS}]"
            before = F.regexp_extract(F.substr(said, F.lit(1), acc["start"]), f"(?:(?<=^|{sep}){some}{{0,{PREFIX}}}{sep})*{some}*$", 0)
            behind = F.regexp_extract(F.substr(said, acc["end"] + 1), f"^{some}*(?:{sep}{some}{{0,{PREFIX}}}(?=$|{sep}))*", 0)
            return F.struct(acc["score"].alias("score"), (acc["start"] - F.length(before)).alias("start"), (acc["end"] + F.length(behind)).alias("end"))

        return let(F.aggregate(_cells(said), none, step), widen)

    def is_random(self, stretch: Column) -> Column:
        return (stretch["score"] > self.threshold) & (stretch["end"] - stretch["start"] >= MIN_RANDOM)


def train(spark: SparkSession, samples: DataFrame | None = None, words: Sequence[str] = ()) -> MarkovModel:
    """Count both chains (add 0.5 to each cell) and place the threshold on the ordinary samples.

    ``samples`` has ``random boolean, said string``; at most alphabet squared
    counts come to the driver.
    """
    samples = labelled_samples(spark, words=words) if samples is None else samples
    width = len(ALPHABET) + 1
    counts = samples.select("random", F.explode(_cells(F.col("said"))).alias("cell")).groupBy("random", "cell").count().collect()
    seen = {(r["random"], r["cell"]): r["count"] for r in counts}
    ratios = [0.0] * (width * width)
    for a in range(width):
        share = {}
        for label in (True, False):
            own = [seen.get((label, a * width + b), 0) + 0.5 for b in range(1, width)]
            whole = sum(own)
            share[label] = [x / whole for x in own]
        for b in range(1, width):
            ratios[a * width + b] = math.log(share[True][b - 1] / share[False][b - 1])
    model = MarkovModel(tuple(ratios), 0.0)
    limit = samples.where("not random").agg(F.percentile(model.stretch(F.col("said"))["score"], F.lit(1 - FALSE_SHARE))).first()[0]
    return MarkovModel(tuple(ratios), max(round(limit or 0.0, 3), MARGIN))


def find_secrets(df: DataFrame, model: MarkovModel, text_column: str = "text") -> DataFrame:
    """``df`` with ``secrets``: an array of ``(start, rank, end)`` by start, then kind; ``rank`` is the place in ``KINDS``."""
    text = text_or_empty(text_column)
    assign = F.filter(
        F.arrays_zip(matches(text, ASSIGN, 2).alias("m")), lambda z: F.length(z["m"]["said"]) >= MIN_ASSIGN
    )
    assign = F.transform(assign, lambda z: z["m"])
    # a run that is long enough is a maximal run, so the length can stand in the pattern
    access = matches(text, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}")
    hexes = matches(text, f"[0-9a-f]{{{MIN_HEX},}}")
    base = F.concat(_as_spans(assign, "assign"), _as_spans(access, "access"), _as_spans(hexes, "hex"))

    def guesses(base: Column) -> Column:
        free = F.when(F.size(base) > 0, _replaced(text, _merged(base), lambda n: F.repeat(F.lit(" "), n))).otherwise(text)
        found = F.transform(matches(free, CANDIDATE), lambda m: F.struct(m["start"].alias("at"), model.stretch(m["said"]).alias("best")))
        random = F.filter(found, lambda f: model.is_random(f["best"]))
        return F.transform(random, lambda f: F.struct((f["at"] + f["best"]["start"]).alias("start"), F.lit(KINDS.index("random")).alias("rank"), (f["at"] + f["best"]["end"]).alias("end")))

    return df.withColumn("secrets", let(F.array_sort(base), lambda b: F.array_sort(F.concat(b, guesses(b)))))


_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _merged(spans: Column) -> Column:
    """Spans, sorted by start, with those that overlap made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"))
        begun = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(begun, F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(_SPANS), add)


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each of its spans, disjoint and in order, replaced by ``by(its length)``."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        before = F.substr(text, acc["at"], s["start"] + 1 - acc["at"])
        return F.struct((s["end"] + 1).alias("at"), F.concat(acc["out"], F.array(before, by(s["end"] - s["start"]))).alias("out"))

    return F.aggregate(spans, start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"])))


def _say(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def secret_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: MarkovModel | None = None) -> DataFrame:
    """Counts by pattern, digest of the pattern spans and all spans of each text."""
    model = model or train(df.sparkSession)
    found = find_secrets(df.select(id_column, text_column), model, text_column)
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        id_column,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_say(base), 256).alias("base_sha256"),
        _say(F.col("secrets")).alias("spans"),
    )


def redact(df: DataFrame, model: MarkovModel, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span masked in its text. Overlapping spans share one mask.

    Texts without spans stay as they are, nulls included.
    """
    found = find_secrets(df, model, text_column)
    text = F.col(text_column)
    whole = _replaced(text, _merged(F.col("secrets")), lambda n: F.lit(mask))
    return found.withColumn(text_column, F.when(F.size("secrets") > 0, whole).otherwise(text)).drop("secrets")
