"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Words are runs of characters other than ASCII white space; lines are split at line feeds and
normalised by lower-casing and joining their words with single spaces.  A line is common for a
host when more than ``limit`` distinct documents of that host have it, where the limit is the larger
of ``min_documents`` and ``share`` of the host's documents.  Documents are distinct by content here:
exact copies are one document, since removing copies is another operator's work.  Common lines are
removed: ``keep`` gives the texts without them.  A document is rejected as depleted when fewer than ``min_words`` words or less than
``min_left`` of its words remain.  Before that, the rules on the document itself reject texts of too
few words and texts that repeat themselves (``base_failed``).

Frequencies are counted over all documents and all lines.  Counts are combined inside each task
before the shuffle and are keyed by host and line together, so a host with a third of all
documents spreads over all tasks; the few common lines are repeated once per salt for the join
back, so that a line that every document has is spread too.

A verdict depends on host and text alone, so it is found once for equal rows and joined back by
two 64-bit hashes of the text.  Null and empty texts have no words, fail the base rules and are
rejected.  A null host is one more host.  Repeated rows get equal verdicts.  Extra columns are kept by
``keep``; names starting with ``_q_`` are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
MIN_DOCUMENTS = 20
SHARE = 0.05
MIN_LEFT = 0.3
SALTS = 8

_BLANK = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK))


def _window_hashes(words: str, window: int) -> str:
    """SQL of the hashes of all windows of consecutive words; empty for shorter texts."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(window))
    return (f"CASE WHEN size({words}) < {window} THEN CAST(array() AS array<bigint>) ELSE "
            f"transform(sequence(0, size({words}) - {window}), i -> xxhash64({parts})) END")


def _repeated_words(hashes: str, window: int) -> str:
    """SQL of the number of words inside windows that occur twice or more.

    Windows sorted by hash and position put equal ones side by side; the positions of those with
    an equal neighbour, in order, cover ``window`` words each, less what the next one covers.
    """
    pairs = f"sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))"
    return f"""CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE
      aggregate(
        sort_array(transform(
          filter(
            transform(array({pairs}), s -> transform(s, (p, k) -> named_struct(
              'i', p.i, 'same', (k > 0 AND p.h = s[greatest(k - 1, 0)].h)
                             OR (k < size(s) - 1 AND p.h = s[least(k + 1, size(s) - 1)].h))))[0],
            p -> p.same),
          p -> p.i)),
        named_struct('n', 0L, 'next', 0),
        (acc, i) -> named_struct('n', acc.n + i + {window} - greatest(i, acc.next), 'next', i + {window}),
        acc -> acc.n) END"""


def measures(documents: DataFrame, min_words: int = MIN_WORDS,
             max_repeated_percent: int = MAX_REPEATED_PERCENT, window: int = REPEAT_WINDOW) -> DataFrame:
    """The documents with the figures of the rules on a single text.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.withColumn("_q_words", words_of(F.col("text"))).withColumn(
        "_q_hashes", F.expr(_window_hashes("_q_words", window)))
    full = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(_TRIM)) != "")
    return (
        split
        .withColumn("n_words", F.size("_q_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_q_words", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"))
        .withColumn("_q_lines", full)
        .withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"))
        .withColumn("n_repeat_words", F.expr(_repeated_words("_q_hashes", window)).cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < min_words)
                    | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")))
        .drop("_q_words", "_q_hashes", "_q_lines")
    )


def _content(host: str) -> list[Column]:
    """Identity of host and text: what a verdict depends on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("_q_host"),
            F.xxhash64(text).alias("_q_a"), F.xxhash64(text, F.lit(1)).alias("_q_b")]


def _normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(line, F.lit(_TRIM)), _BLANK, " "))


def _normalised_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _normalised)
    return F.filter(lines, lambda line: line != "")


def line_table(documents: DataFrame, host: str = "source") -> DataFrame:
    """Per document its host, identity, number of words, and line hashes each with its words.

    Written to the scratch folder, since two steps read it.
    """
    lines = F.transform(_normalised_lines(F.col("text")), lambda line: F.struct(
        F.xxhash64(line).alias("line"), F.size(F.split(line, " ")).alias("words")))
    table = documents.select(*_content(host), F.monotonically_increasing_id().alias("_q_row"),
                             lines.alias("_q_lines"))
    return materialize(table.withColumn("_q_words", F.aggregate(
        "_q_lines", F.lit(0).cast("bigint"), lambda total, line: total + line["words"])), "lines")


def common_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """Host, hash and number of distinct documents of the lines above the host's limit.

    Counting rows first, copies included, leaves few lines for the exact count of distinct ones.
    """
    limits = (lines.select("_q_host", "_q_a", "_q_b").distinct().groupBy("_q_host").count()
              .select("_q_host", F.greatest(F.lit(min_documents), F.col("count") * share).alias("limit")))
    each = lines.select("_q_host", F.explode(F.array_distinct("_q_lines.line")).alias("line"))
    counted = each.groupBy("_q_host", "line").count().where(F.col("count") > min_documents)
    candidates = materialize(counted.join(limits, "_q_host").where(F.col("count") > F.col("limit"))
                             .select("_q_host", "line", "limit"), "line-candidates")
    rows = _lines_in(lines, candidates).select("_q_host", "line", "limit", "_q_a", "_q_b").distinct()
    return materialize(rows.groupBy("_q_host", "line", "limit").agg(F.count("*").alias("documents"))
                       .where(F.col("documents") > F.col("limit")).drop("limit"), "common-lines")


def _lines_in(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per document and occurrence of a chosen line; salted, as a line may be everywhere."""
    salt = F.pmod(F.col("_q_a"), F.lit(SALTS)).cast("int")
    left = lines.select("_q_host", "_q_row", "_q_a", "_q_b", "_q_words", F.explode("_q_lines").alias("l")).select(
        "_q_host", "_q_row", "_q_a", "_q_b", "_q_words", "l.line", "l.words", salt.alias("salt"))
    right = chosen.withColumn("salt", F.explode(F.array(*(F.lit(s) for s in range(SALTS)))))
    return left.join(right, ["_q_host", "line", "salt"])


def stripped(documents: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS,
             share: float = SHARE, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """Identities of the texts with common lines, the hashes of these, and whether too little remains without."""
    lines = line_table(documents, host)
    found = _lines_in(lines, common_lines(lines, min_documents, share))
    left = F.col("_q_words") - F.sum("words")
    rows = found.groupBy("_q_row", "_q_host", "_q_a", "_q_b", "_q_words").agg(
        left.alias("left"), F.collect_set("line").alias("_q_common"))
    gone = (F.col("left") < min_words) | (F.col("left") < min_left * F.col("_q_words"))
    # Rows of one identity have the same lines.
    return rows.groupBy("_q_host", "_q_a", "_q_b").agg(F.max(gone).alias("_q_gone"), F.first("_q_common").alias("_q_common"))


def depleted(documents: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """Identities of the texts of which too little remains without the common lines."""
    return stripped(documents, host, **limits).where("_q_gone").select("_q_host", "_q_a", "_q_b")


def verdicts(documents: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The documents with all measures and ``kept``; a measure takes the place of a column of its name."""
    gone = depleted(documents, host, **limits).withColumn("_q_gone", F.lit(True))
    measured = measures(documents)
    identity = measured.select("*", *_content(host)).drop("text")
    return (identity.join(gone, ["_q_host", "_q_a", "_q_b"], "left")
            .withColumn("kept", ~F.col("base_failed") & F.col("_q_gone").isNull())
            .drop("_q_host", "_q_a", "_q_b", "_q_gone"))


def _without(text: Column, common: Column) -> Column:
    """A text without the lines whose hashes are given; blank lines stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: (_normalised(line) == "")
                                 | ~F.array_contains(common, F.xxhash64(_normalised(line)))), "\n")


def keep(documents: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The documents that are kept, with their own columns, their texts without the common lines.

    Texts without such lines stay as they are; where a text changes, so does ``n_chars``.
    """
    found = materialize(stripped(documents, host, **limits), "stripped")
    # Through a generator, as a filter on computed columns would be pushed down and computed again and again.
    whole = documents.select(F.struct(*documents.columns).alias("_q_own"), *_content(host), "text")
    fine = (measures(whole).select("_q_own.*", "_q_host", "_q_a", "_q_b",
                                   F.explode(F.array(~F.col("base_failed"))).alias("_q_fine")).where("_q_fine"))
    kept = fine.join(found, ["_q_host", "_q_a", "_q_b"], "left").where(~F.coalesce("_q_gone", F.lit(False)))
    changed = F.col("_q_common").isNotNull()
    kept = kept.withColumn("text", F.when(changed, _without(F.col("text"), F.col("_q_common"))).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(documents.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return kept.select(*documents.columns)
