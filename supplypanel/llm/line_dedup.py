"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is removed if an earlier one (by document, then by place in it) has the same words
or word sets with a Jaccard similarity of at least ``THRESHOLD`` percent. Words are the
parts of a line, in lower case, between spaces and tabs; carriage returns are ignored.
Lines without words are kept.

* Words are ordered by rarity: by how often their hash bucket occurs in all lines, in powers
  of two, then by hash. The bucket counts are a table of fixed size.
* Lines of equal sets are one set, at the place of the first. Sets of fewer than 4 words
  are similar to equal sets only.
* Prefix filter: similar sets share a word among the first ``n - ceil(t n) + 1`` of the
  larger and the first ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller. Length filter: the
  smaller has at least ``t`` times the words of the larger. Positional filter: what can
  still follow a shared word must suffice. Parity words per set, whose differing bits are
  at most the differing words, are compared too: 64 bits, 128 of sets of more than 64 words.
* A prefix word of more than ``FEW`` sets is no key by itself. Two similar sets that have it as
  their first common word share another one in their prefixes of one word more, so the two
  words together are the key; as the frequent words are the last of a prefix, these are few.
* The sets of a key are first compared with the earliest of them. Only those that may not be
  similar to it are compared with all earlier ones; so are, in a second search, those that
  turned out not to be similar to any set they were compared with. Copies that differ a little
  are so not compared with one another. Keys of at most ``FEW`` sets are searched in one join.
* A prefix word goes with the place of its set, the filters' numbers and no more, and is dealt
  by key once for both sides of the join.
* Candidates are verified by their whole word sets.

Documents whose ``doc_id`` is null, and null or empty texts, are returned as they are and
take no part. Rows that are equal in ``doc_id`` and text are one document; of different
texts of one ``doc_id``, the one with the lower hash is the earlier. Every other column of
the input is returned as it is. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from .common import among, bitmap, dense, drop_folder, maybe_in, table, written

THRESHOLD = 80
RARITY_BUCKETS = 1 << 20
# comparing with so many sets costs less than one shuffled row for each further prefix word
FEW = 512
_HASH_BITS = 56
_PARITY_BITS = 64
SMALLEST = 4


def _lines(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")


def _words(line: Column) -> Column:
    return F.split(F.lower(F.replace(line, F.lit("\t"), F.lit(" "))), " ")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text != ''").select(
        "doc_id", F.xxhash64("text").alias("version"), "text"
    )


def _rarity(texts: DataFrame) -> Column:
    """For each hash bucket of words the power of two up to which its count reaches."""
    # a line break is one more space here
    one_line = F.replace(F.replace(F.col("text"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    counts = (
        texts.select(F.explode(_words(one_line)).alias("word"))
        .where("word != ''")
        .groupBy(F.pmod(F.xxhash64("word"), F.lit(RARITY_BUCKETS)).alias("bucket"))
        .count()
    )
    power = F.ceil(F.log2("count")).cast("tinyint")
    return dense(counts.select("bucket", power.alias("power")), "bucket", "power", RARITY_BUCKETS, "tinyint")


def _ordered_words(line: Column, powers: Column) -> Column:
    """The distinct words of a line as numbers, the rarest first."""
    nothing = F.xxhash64(F.lit(""))
    hashes = F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), nothing)

    def numbered(h: Column) -> Column:
        power = F.coalesce(F.get(powers, F.pmod(h, F.lit(RARITY_BUCKETS)).cast("int")), F.lit(0))
        return F.shiftleft(power.cast("long"), _HASH_BITS).bitwiseOR(
            h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
        )

    return F.sort_array(F.transform(hashes, numbered))


def _parity(words: Column) -> Column:
    return F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda out, w: out.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
        ),
    )


def _probe_length(n: Column, t: int) -> Column:
    return n - F.floor((n * t + 99) / 100) + 1


def _index_length(n: Column, t: int) -> Column:
    return n - F.floor((n * (2 * t) + (99 + t)) / (100 + t)) + 1


_LINE = ("doc_id", "version", "line")


def _numbered_lines(texts: DataFrame) -> DataFrame:
    return texts.select(
        "doc_id", "version", F.posexplode(_lines(F.col("text"))).alias("line", "content")
    )


def _contents(texts: DataFrame) -> DataFrame:
    """The lines that have words."""
    return _numbered_lines(texts).where(
        F.trim(F.replace(F.col("content"), F.lit("\t"), F.lit(" "))) != ""
    )


def _with_words(contents: DataFrame, powers: Column) -> DataFrame:
    """Lines with their words in order. The optimizer moves the scalar subquery ``powers``
    from its column into the expression that uses it."""
    return contents.select(*_LINE, "content", powers.alias("powers")).select(
        *_LINE, _ordered_words(F.col("content"), F.col("powers")).alias("words")
    )


def _may_match(x: str, y: str, t: int) -> Column:
    """Length, positional and parity filters for two sets, whichever is the larger."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    px, py = F.col(f"{x}.pos"), F.col(f"{y}.pos")
    need = F.floor(((nx + ny) * t + (99 + t)) / (100 + t))
    smaller, at = F.least(nx, ny), F.when(nx < ny, px).otherwise(py)
    ones = F.col(f"{x}.parity").bitwiseXOR(F.col(f"{y}.parity"))
    upper = F.col(f"{x}.upper").bitwiseXOR(F.col(f"{y}.upper"))
    # the upper half of the words' parities is known of large sets
    bits = F.coalesce(F.bit_count(upper) + F.bit_count(ones.bitwiseXOR(upper)), F.bit_count(ones))
    return (
        (smaller * 100 >= F.greatest(nx, ny) * t)
        & (at < _index_length(smaller, t))
        & (F.least(nx - px, ny - py) >= need)
        & (bits <= nx + ny - need * 2)
    )


def _earlier(y: str, x: str) -> Column:
    """Whether the place of ``y`` is before that of ``x``."""
    def same(k: str) -> Column:
        return F.col(f"{y}.{k}") == F.col(f"{x}.{k}")

    def before(k: str) -> Column:
        return F.col(f"{y}.{k}") < F.col(f"{x}.{k}")

    return before("doc") | (same("doc") & (before("turn") | (same("turn") & before("line"))))


def _pair(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs ``a``, ``b`` of sets with columns of ``rows`` (by ``s``) as ``x`` and ``y``."""
    one = rows.select(F.col("s").alias("a"), F.struct(*columns).alias("x"))
    two = rows.select(F.col("s").alias("b"), F.struct(*columns).alias("y"))
    return pairs.join(one, "a").join(two, "b")


def _similar(pairs: DataFrame, words: DataFrame, t: int) -> DataFrame:
    """The later set of each pair (``a``, ``b``) that reaches the threshold: its name ``s`` and
    its ``place``. Pairs are first compared by 15 bits of each word, which can only hide
    differences."""
    n = F.col("x.n") + F.col("y.n")
    need = F.floor((n * t + (99 + t)) / (100 + t))
    differ = F.size(F.array_except("x.bits", "y.bits")) + F.size(F.array_except("y.bits", "x.bits"))
    likely = _pair(pairs, words, ["n", "bits"]).where(differ <= n - need * 2).select("a", "b")
    both = F.size(F.array_intersect("x.words", "y.words"))
    close = _pair(likely, words, ["n", "words", "place"]).where(both * 100 >= (n - both) * t)
    x, y = F.col("x.place"), F.col("y.place")
    later = F.when(x > y, F.col("a")).otherwise(F.col("b"))
    return close.select(later.alias("s"), F.greatest(x, y).alias("place")).distinct()


def decide_lines(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """``doc_id``, ``version`` (the text's hash), ``line`` and whether it is ``removed``, for
    every line that has words; and the scratch folders that the result is read from."""
    spark = docs.sparkSession
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, folder = written(df, name)
        folders.append(folder)
        return out

    def known(keys: DataFrame, column: str) -> Callable[[Column], Column]:
        """``maybe_in`` whose bitmap is made once and read by all queries that ask it."""
        marks = spark.range(1).select(bitmap(keys, column).alias("bits"))
        return among(keep(marks, "bitmap").scalar())

    texts = _documents(docs)
    counted = keep(spark.range(1).select(_rarity(texts).alias("powers")), "rarity")
    powers = counted.scalar()
    n = F.size("words")
    # one word more than the prefix filter needs
    prefix = F.slice("words", F.lit(1), (_probe_length(n, threshold) + 1).cast("int"))
    upper = F.filter("words", lambda w: w.bitwiseAND(F.lit(_PARITY_BITS)) != 0)
    lines = keep(
        _with_words(_contents(texts), powers).select(
            *_LINE,
            F.xxhash64("words").alias("s"),
            n.alias("n"),
            F.when(n >= SMALLEST, _parity(F.col("words"))).alias("parity"),
            F.when(n > _PARITY_BITS, _parity(upper)).alias("upper"),
            # half as wide; words that coincide only make more candidates
            F.when(n >= SMALLEST, F.transform(prefix, lambda w: F.hash(w))).alias("prefix"),
        ),
        "lines",
    )
    versions = lines.groupBy("doc_id").agg(F.min("version").alias("low"), F.max("version").alias("high"))
    in_versions = known(versions.where("low != high"), "doc_id")

    def turn(doc_id: str, version: str) -> Column:
        """Orders the texts of one ``doc_id``; 0 where there is but one."""
        return F.when(in_versions(F.col(doc_id)), F.col(version)).otherwise(F.lit(0).cast("long"))

    # sets are named by their places, so that these alone go with each prefix word
    name = F.xxhash64("doc", "turn", "line")
    line_name = F.xxhash64("doc_id", turn("doc_id", "version"), "line")
    # a set that only one line has needs no search for its first line
    several = known(lines.groupBy("s").count().where("count > 1"), "s")
    traits = ["n", "parity", "upper", "prefix"]
    places = keep(
        lines.where(several(F.col("s")))
        .groupBy("s")
        .agg(F.min(F.struct(*_LINE)).alias("place"), *[F.first(k).alias(k) for k in traits]),
        "places",
    )
    large = F.col("n") >= SMALLEST
    alone = lines.where(large & ~several(F.col("s"))).select(*_LINE, *traits)
    sets = alone.unionByName(places.where(large).select("place.*", *traits)).select(
        F.col("doc_id").alias("doc"), turn("doc_id", "version").alias("turn"), "line", *traits
    )
    needed = F.slice("prefix", F.lit(1), F.size("prefix") - 1)
    # all prefix words are counted, so that the rows to count grow as the input does
    prefix_words = sets.select(F.explode(needed).alias("word")).groupBy("word").count()
    # some other words may pass as frequent; all their lines then do
    is_frequent = known(prefix_words.where(F.col("count") > FEW), "word")
    marks = ["doc", "turn", "line", "n", "parity", "upper"]
    after = F.slice("prefix", F.col("pos") + 2, F.size("prefix"))
    entries = sets.select(F.posexplode(needed).alias("pos", "word"), "prefix", *marks)
    single = entries.where(~is_frequent(F.col("word"))).select("pos", "word", *marks)
    with_others = keep(
        entries.where(is_frequent(F.col("word"))).select("pos", "word", after.alias("others"), *marks),
        "frequent-words",
    )
    double = with_others.select("pos", "word", F.explode("others").alias("other"), *marks).select(
        "pos", F.hash("word", "other").alias("word"), *marks
    )
    is_often = known(double.groupBy("word").count().where(F.col("count") > FEW), "word")
    rare = single.unionByName(double.where(~is_often(F.col("word"))))
    often = keep(double.where(is_often(F.col("word"))), "frequent-entries").withColumn("s", name)

    # a key of these has at most FEW sets; "led" by the earliest if that may be similar
    itself = F.struct("doc", "turn", "line", "s", "n", "pos", "parity", "upper")
    # dealt by key once, for the earliest of each key and for both sides of the join
    dealt = rare.repartition("word").withColumn("s", name)
    followed = dealt.withColumn("lead", F.min(itself).over(W.partitionBy("word"))).alias("x")
    may_follow = _may_match("x", "x.lead", threshold)
    x = followed.where("lead.s != s").select("word", "pos", "s", *marks, may_follow.alias("led"), F.col("lead.s").alias("lead"))
    x, y = x.alias("x"), dealt.alias("y")
    chosen = F.when(F.col("x.led"), F.col("y.s") == F.col("x.lead")).otherwise(
        _earlier("y", "x") & _may_match("x", "y", threshold)
    )
    both = [
        F.col(f"{side}.{k}").alias(to)
        for side, k, to in (("x", "s", "a"), ("y", "s", "b"), ("x", "doc", "doc_a"), ("y", "doc", "doc_b"))
    ]
    at_once = x.join(y, (F.col("x.word") == F.col("y.word")) & chosen).select(*both, "x.led")
    earliest = often.groupBy("word").agg(F.min(itself).alias("y"))
    with_earliest = often.select("word", itself.alias("x")).join(earliest, "word").where("x.s != y.s")
    # the keys of these are searched again for all sets that are left
    led = with_earliest.where(_may_match("x", "y", threshold)).select(*both, F.lit(False).alias("led"))
    names = ["a", "b", "doc_a", "doc_b"]
    first = keep(at_once.union(led).groupBy(*names).agg(F.max("led").alias("led")), "pairs")

    def words_of(pairs: DataFrame) -> DataFrame:
        """The whole word sets in the pairs, read from the lines they are first in."""
        wanted = keep(
            pairs.select("a", "doc_a").union(pairs.select("b", "doc_b")).toDF("s", "doc").distinct(),
            "wanted",
        )
        in_document = known(wanted, "doc")
        contents = _numbered_lines(texts.where(in_document(F.col("doc_id")))).where(
            known(wanted, "s")(line_name)
        )
        bits = F.transform("words", lambda w: w.bitwiseAND(F.lit(32767)).cast("smallint"))
        # a set that no pair has may come along; no pair is joined with it
        return keep(
            _with_words(contents, powers)
            .select(line_name.alias("s"), "words", F.struct(*_LINE).alias("place"))
            .dropDuplicates(["s"])
            .select("s", "words", n.alias("n"), F.array_distinct(bits).alias("bits"), "place"),
            "words",
        )

    gone = keep(_similar(first.select("a", "b"), words_of(first), threshold), "gone")
    # what the earliest sets of its keys did not remove, with all earlier ones of these keys
    asked = keep(
        first.where("led").select(F.col("a").alias("s")).distinct().join(gone, "s", "left_anti"), "asked"
    )
    asking = keep(
        rare.withColumn("s", name).where(known(asked, "s")(F.col("s"))).join(asked, "s", "left_semi"),
        "asked-entries",
    )
    answering = rare.withColumn("s", name).where(known(asking, "word")(F.col("word")))
    left = often.join(gone, "s", "left_anti")

    def earlier_of(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        possible = _earlier("y", "x") & _may_match("x", "y", threshold)
        return x.join(y, (F.col("x.word") == F.col("y.word")) & possible).select(*both)

    second = keep(
        earlier_of(asking, answering)
        .union(earlier_of(left, often))
        .distinct()
        .join(first, ["a", "b"], "left_anti"),
        "pairs",
    )
    if second.limit(1).count():
        gone = keep(
            gone.union(_similar(second.select("a", "b"), words_of(second), threshold)).distinct(), "gone"
        )
    gone_places = gone.select("place.*", F.lit(True).alias("gone"))
    spot = F.xxhash64(*_LINE)
    # all other lines are the only ones of a set that stays
    concerned = several(F.col("s")) | known(gone_places.select(spot.alias("at")), "at")(spot)
    removed = F.col("gone").isNotNull() | F.coalesce(F.struct(*_LINE) != F.col("place"), F.lit(False))
    asked = (
        lines.where(concerned)
        .select(*_LINE, "s")
        .join(places.select("s", "place"), "s", "left")
        .join(gone_places, list(_LINE), "left")
    )
    done, folder = written(
        asked.select(*_LINE, removed.alias("removed"))
        .distinct()
        .unionByName(lines.where(~concerned).select(*_LINE, F.lit(False).alias("removed"))),
        "decided",
    )
    for path in folders:
        drop_folder(spark, path)
    return done, [folder]


def dedup_lines(
    docs: DataFrame, threshold: int = THRESHOLD, names: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """``docs`` with ``text`` without the removed lines, and how many lines there were and
    how many are removed. Only documents that may have such lines are shuffled."""
    decided, _ = decide_lines(docs, threshold)
    removed = decided.where("removed")
    by_document = removed.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).agg(
        F.collect_list("line").alias("_lines")
    )
    concerned = F.coalesce(maybe_in(removed, "doc_id")(F.col("doc_id")), F.lit(False))
    all_lines = F.when(F.col("text") != "", F.size(F.split("text", "\n"))).otherwise(0)
    counted = docs.withColumn("_n", F.coalesce(all_lines, F.lit(0)).cast("long"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_lines", i))
    changed = (
        counted.where(concerned)
        .join(
            by_document,
            (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_version")),
            "left",
        )
        .select(
            *[
                F.when(F.col("_lines").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c)
                if c == "text"
                else F.col(c)
                for c in docs.columns
            ],
            F.col("_n").alias(names[0]),
            F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias(names[1]),
        )
    )
    same = counted.where(~concerned).select(
        *docs.columns, F.col("_n").alias(names[0]), F.lit(0).cast("long").alias(names[1])
    )
    return changed.unionByName(same)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all documents the number of lines that have words, how many of these are removed,
    and which (their places in the document, in order)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decided, _ = decide_lines(docs)
    by_document = decided.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("removed").alias("n_removed"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line")))), ","
        ).alias("removed_lines"),
    )
    return docs.select("doc_id").join(by_document, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed_lines", F.lit("")).alias("removed_lines"),
    )


OP6_SQL = """
WITH lines AS (
    SELECT doc_id, line,
        list_sort(list_distinct(list_filter(
            string_split(lower(replace(content, chr(9), ' ')), ' '), lambda w: w <> ''))) AS words
    FROM (
        SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS line
        FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS parts
              FROM documents WHERE text <> '')
    )
),
sets AS (
    SELECT words, len(words) AS n, min({'d': doc_id, 'l': line}) AS place
    FROM lines WHERE len(words) > 0 GROUP BY words
),
pairs AS (
    SELECT x.place AS a, y.place AS b, x.n + y.n AS n, len(list_intersect(x.words, y.words)) AS shared
    FROM sets x JOIN sets y ON y.n <= x.n AND y.n * 100 >= x.n * 80 AND x.words <> y.words
),
gone AS (
    SELECT DISTINCT CASE WHEN a > b THEN a ELSE b END AS place
    FROM pairs WHERE shared * 100 >= (n - shared) * 80
),
decided AS (
    SELECT l.doc_id, l.line,
        {'d': l.doc_id, 'l': l.line} <> s.place OR g.place IS NOT NULL AS removed
    FROM lines l JOIN sets s ON l.words = s.words LEFT JOIN gone g ON g.place = s.place
)
SELECT d.doc_id,
    count(line)::BIGINT AS n_lines,
    count(*) FILTER (removed)::BIGINT AS n_removed,
    coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (removed), '') AS removed_lines
FROM documents d LEFT JOIN decided f ON f.doc_id = d.doc_id
GROUP BY d.doc_id
"""
