"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from steepgrid.llm.linking import probably_in
from steepgrid.llm.words import unused
from steepgrid.session import materialise

MIN_WORDS = 6  # of lines that can be near copies
EXACT_WORDS = 1  # of lines that go as exact repeats in the query and the pipeline
_BLANKS = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"
_RARE = "\t\v\f\r"  # blanks that few lines have


def _words(line: Column) -> Column:
    """The words of a line; one with spaces only is split without a pattern, which costs much less."""
    rare = reduce(lambda a, b: a | b, [F.contains(line, F.lit(c)) for c in _RARE])
    return F.array_remove(F.when(rare, F.split(line, _BLANKS)).otherwise(F.split(line, " ")), "")


def _half_keys(words: Column, n: Column) -> Column:
    """Hashes that two lines within one edit of each other share at least one of.

    If m is the shorter one's length, the edit lies behind the first m // 2 words or before the last
    m // 2, so one of these runs is the same in both. A line does not know whether its partner is shorter by one
    word, so it has the keys of m = n and of m = n - 1.
    """

    def key(kind: int, m: Column, first: Column) -> Column:
        return F.xxhash64(F.lit(kind), m, F.slice(words, first, F.floor(m / 2).cast("int")))

    keys = []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        keys += [key(0, m, F.lit(1)), key(1, m, n - half + 1)]
    return F.array(*keys)


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one inserted, deleted or replaced word apart."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    differs = F.zip_with(short, long, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True).cast("int")  # 1-based place of the first difference, 0 without one
    rest = F.size(long)
    return (
        F.when(F.size(long) - F.size(short) > 1, F.lit(False))
        .when(at == 0, F.lit(True))
        .when(
            F.size(long) == F.size(short), F.slice(short, at + 1, rest).eqNullSafe(F.slice(long, at + 1, rest))
        )
        .otherwise(F.slice(short, at, rest).eqNullSafe(F.slice(long, at + 1, rest)))
    )


def drop_near_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    exact_words: int | None = None,
) -> DataFrame:
    """Remove every line that equals, or is one word-edit away from, a line that comes earlier.

    Lines are parted by line feeds and compared as word sequences; an edit inserts, deletes or replaces one word.
    Earlier means a smaller (id, line number) of a line's first occurrence. Lines under ``min_words``
    words are no near copies of any line; those of at least ``exact_words`` words still go if they equal an earlier
    one. Shorter ones, by default all under ``min_words``, are kept as they are.

    1. Equal lines are one line. A line goes on only if it shares a half (see ``_half_keys``) with another: no pair
       within the bound is lost, and few lines are left.
    2. Each of these lines emits one hashed key per word it could lose. The keys of all n variants come from running
       XORs of position-salted word hashes, so a line costs its length and not its square.
    3. Lines with an equal variant at an equal place differ by a replaced word: each is joined with the earliest of
       them, not with all. A variant equal to a whole line is an inserted word. Pairs are verified word by word.
    4. Occurrences to drop are gathered per document and its text is put together from the other lines.

    Returns all columns of ``docs`` with the new text, then ``n_lines`` and ``n_removed``, which take the place of columns
    of these names; other columns may have any name. Null text stays null with 0
    lines; a text that loses all lines becomes empty. Null ids come last in the order. Rows that repeat both id
    and text are one document and get the same result. An empty table gives an empty result.
    """
    columns = docs.columns
    own = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    texts = docs.select(own.alias("_doc"), order.alias("_id"), F.col(text_col).alias("_text"))  # hashed once, not for every line
    lines = texts.select("_doc", "_id", F.posexplode(F.split("_text", "\n")).alias("_no", "_line"))
    least = min_words if exact_words is None else min(exact_words, min_words)
    if least == 1:  # a condition on the words would split every line twice: once in the filter, once behind it
        words = lines.where(F.col("_line").rlike(_WORD)).withColumn("_words", _words(F.col("_line")))
    else:
        words = lines.withColumn("_words", _words(F.col("_line"))).where(F.size("_words") >= least)
    words = words.withColumn("_hash", F.xxhash64("_words")).drop("_line")
    n = F.size("_words")
    keys = F.when(n >= min_words, _half_keys(F.col("_words"), n)).otherwise(F.array().cast("array<bigint>"))
    found = materialise(words.select("_doc", "_id", "_no", "_hash", keys.alias("_keys")), "lines")
    distinct = materialise(
        found.groupBy("_hash").agg(
            F.min(F.struct("_id", "_no")).alias("_first"),
            F.count("*").alias("_times"),
            F.any_value("_keys").alias("_keys"),
        ),
        "distinct-lines",
    )
    keys = distinct.select("_hash", F.explode(F.array_distinct("_keys")).alias("_key"))
    shared = materialise(keys.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1").select("_key"), "half-keys")
    near = materialise(probably_in(keys, "_key", shared).select("_hash").distinct(), "near-lines")

    firsts = distinct.join(near, "_hash", "left_semi").select(F.col("_hash").alias("_h"), "_first")
    candidates = materialise(
        probably_in(words.select("_id", "_no", "_hash", "_words"), "_hash", near)
        .join(
            firsts,
            (F.col("_hash") == F.col("_h")) & (F.col("_id") == F.col("_first._id")) & (F.col("_no") == F.col("_first._no")),
        )
        .groupBy("_hash")
        .agg(F.any_value("_words").alias("_words"), F.any_value("_first").alias("_first")),
        "candidate-lines",
    )

    # variant without word i: words before i keep their places, words behind move up by one
    placed = candidates.select(
        "_hash", "_first", F.posexplode("_words").alias("_at", "_word")
    ).select(
        "_hash",
        "_first",
        "_at",
        F.xxhash64("_word", "_at").alias("_here"),
        F.xxhash64("_word", F.col("_at") - 1).alias("_moved"),
    )
    line = Window.partitionBy("_hash").orderBy("_at")
    running = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entire = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    variants = materialise(
        placed.select(
            "_hash",
            F.struct(F.col("_first._id").alias("id"), F.col("_first._no").alias("no"), F.col("_hash").alias("hash")).alias("_order"),
            "_at",
            F.bit_xor("_here").over(running).bitwiseXOR(F.col("_here")).alias("_before"),
            F.bit_xor("_moved").over(running).alias("_moved_to"),
            F.bit_xor("_moved").over(entire).alias("_moved_all"),
            F.bit_xor("_here").over(entire).alias("_whole"),
        ).select(
            "_order",
            "_at",
            F.col("_before").bitwiseXOR(F.col("_moved_to")).bitwiseXOR(F.col("_moved_all")).alias("_variant"),
            F.when(F.col("_at") == 0, F.col("_whole")).alias("_whole"),
        ),
        "variants",
    )
    cliques = (
        variants.groupBy(F.xxhash64("_variant", "_at").alias("_k"))
        .agg(F.min("_order").alias("_early"), F.count("*").alias("_c"))
        .where("_c > 1")
        .drop("_c")
    )
    cliques = materialise(cliques, "cliques")
    replaced = (
        probably_in(variants.select(F.xxhash64("_variant", "_at").alias("_k"), "_order"), "_k", cliques.select("_k"))
        .join(cliques, "_k")
        .where(F.col("_early") < F.col("_order"))
        .select(F.col("_order.hash").alias("late"), F.col("_early.hash").alias("early"))
    )
    wholes = variants.where("_whole is not null").select(F.col("_whole").alias("_w"), F.col("_order").alias("_other"))
    inserted = probably_in(variants.select("_variant", "_order"), "_variant", wholes).join(
        wholes, F.col("_variant") == F.col("_w")
    )
    inserted = inserted.where(F.col("_order") != F.col("_other")).select(
        F.greatest("_order", "_other")["hash"].alias("late"), F.least("_order", "_other")["hash"].alias("early")
    )
    pairs = replaced.unionByName(inserted).distinct()
    late, early = (
        candidates.select(F.col("_hash").alias(f"_{s}"), F.col("_words").alias(f"{s}_words")) for s in ("late", "early")
    )
    dropped = (
        pairs.join(late, F.col("late") == F.col("_late"))
        .join(early, F.col("early") == F.col("_early"))
        .where(_within_one_edit(F.col("late_words"), F.col("early_words")))
        .select("late")
        .distinct()
    )
    dropped = materialise(dropped, "dropped-lines")

    again = distinct.join(dropped, distinct["_hash"] == dropped["late"], "left").where(
        (F.col("_times") > 1) | F.col("late").isNotNull()
    )
    again = materialise(
        again.select(F.col("_hash").alias("_h"), "_first", F.col("late").isNotNull().alias("_near")), "repeated-lines"
    )
    of, places, pieces = unused([*columns, "n_lines", "n_removed"], "_of", "_gone", "_pieces")
    gone = (
        probably_in(found.select("_doc", "_id", "_no", "_hash"), "_hash", again.select("_h"))
        .join(again, F.col("_hash") == F.col("_h"))
        .where(F.col("_near") | (F.col("_first") != F.struct("_id", "_no")))
        .groupBy(F.col("_doc").alias(of))
        .agg(F.collect_set("_no").alias(places))
    )
    none = F.array().cast("array<int>")
    parts = F.col(pieces)
    count = F.coalesce(F.size(parts), F.lit(0))
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce(places, none))
    text = F.when(F.col(places).isNull(), docs[text_col]).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get(parts, i)), "\n")
    )
    kept = [c for c in columns if c.lower() not in ("n_lines", "n_removed")]
    return (
        docs.join(materialise(gone, "dropped-places"), own == F.col(of), "left")
        .withColumn(pieces, F.split(docs[text_col], "\n"))  # once, not for every line kept
        .select(
            *[text.alias(c) if c == text_col else docs[c] for c in kept],
            F.when(docs[text_col].isNull(), 0).otherwise(count).alias("n_lines"),
            F.size(F.coalesce(places, none)).alias("n_removed"),
        )
    )
