"""Line deduplication by a log-template tree."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import few, free, row_key, staged

DEPTH = 3
RUNS, KEPT_RUNS = 5, 3
MIN_DOCS, FIELD_DOCS = 2, 3
MIN_TOKENS = 3

FIELD = "<*>"
BLANK = "[ \t\r]+"

# which runs of the positions behind the leading tokens a template keeps, as bits
SUBSETS = [sum(1 << r for r in kept) for kept in combinations(range(RUNS), KEPT_RUNS)]


def masked(text: Column) -> Column:
    """A text whose tokens with a digit have become fields; line feeds stay."""
    # from the beginning of a token only, without going back in it: linear in the token
    return F.regexp_replace(text, r"(?<![^ \t\r\n])[^ \t\r\n0-9]*+[0-9][^ \t\r\n]*+", FIELD)


def tokens(line: Column, most: int = -1) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\r")), BLANK, most)


def masked_lines(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """(doc_id, node, at, size, lead, line): the masked lines of ``least`` tokens or more and their leaves.

    A line falls through a tree of fixed depth: first by its number of tokens (size), then by its leading tokens.
    """
    lines = docs.where(F.col("text").isNotNull()).select(
        "doc_id", row_key("text").alias("node"), F.posexplode(F.split(masked(F.col("text")), "\n")).alias("at", "line"))
    return lines.withColumn("size", F.regexp_count("line", F.lit(r"[^ \t\r]++"))).where(F.col("size") >= least).select(
        "doc_id", "node", "at", "size", F.xxhash64(F.slice(tokens(F.col("line"), depth + 1), 1, depth)).alias("lead"),
        "line")


def generalised(kinds: DataFrame, depth: int) -> DataFrame:
    """(size, lead, kind, subset, kept) for each template of fields that a line of (size, lead, kind, line) fits.

    The positions behind the leading tokens are cut into five runs; a template keeps three of them and makes fields of
    the others. It must keep half of these positions or more, two at least, and not all. So lines that agree on three
    runs share a template, whatever other lines stand in their leaf; no line is compared with another.
    """
    rest = F.slice(tokens(F.col("line")), depth + 1, F.greatest(F.col("size") - depth, F.lit(0)))
    cut = kinds.where(F.col("size") > depth).withColumn("rest", rest).withColumn(
        "subset", F.explode(F.array(*map(F.lit, SUBSETS))))
    kept = F.filter("rest", lambda t, i: F.getbit(F.col("subset").cast("long"), F.floor(i * RUNS / (F.col("size") - depth))) == 1)
    n, m = F.size("kept"), F.col("size") - depth
    return cut.withColumn("kept", kept).where((n >= 2) & (2 * n >= m) & (n < m)).select(
        "size", "lead", "kind", "subset", "kept")


def mixed_leaves(lines: DataFrame) -> DataFrame:
    """The lines of leaves that several texts reach with different lines."""
    many = lines.groupBy("size", "lead").agg(
        F.min("node").alias("a"), F.max("node").alias("b"), F.min("kind").alias("x"), F.max("kind").alias("y"))
    many = few(many.where("a <> b and x <> y").select("size", "lead"))
    return staged(lines.join(many, ["size", "lead"], "left_semi"), "leaves")


def kinds_of(lines: DataFrame) -> DataFrame:
    return lines.select("size", "lead", "kind", "line").distinct()


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    return staged(masked_lines(docs, depth, min_tokens).withColumn("kind", F.xxhash64("line")), "lines")


def recurring(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, field_docs: int = FIELD_DOCS,
              min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(node, drops): the lines of each text, by position, that have a recurring template and are not its first.

    A line's templates are itself, digits masked, and those of ``generalised`` that another line of its leaf fits too.
    A line recurs if ``min_docs`` different texts have it, a template with fields if ``field_docs`` have it: two similar
    lines may be two sentences. The text with the smallest doc_id keeps its lines. Exact copies of a document are one
    text here, so they do not make its lines recur.

    Texts are masked and cut once. What is shuffled per line are hashes of 16 bytes and numbers; counts combine before
    the shuffle, so a line that a third of the documents have costs a row per task.
    """
    lines = _lines(docs, depth, min_tokens)
    leaves = mixed_leaves(lines)
    general = staged(generalised(kinds_of(leaves), depth).select(
        "size", "lead", "kind", F.lit(True).alias("fields"), F.xxhash64("subset", "kept").alias("template")), "templates")
    shared = general.groupBy("size", "lead", "template").agg(F.min("kind").alias("x"), F.max("kind").alias("y"))
    general = few(general.join(shared.where("x <> y").drop("x", "y"), ["size", "lead", "template"]).distinct())
    form = ["size", "lead", "fields", "template"]
    columns = ["doc_id", "node", "at", *form]
    placed = lines.drop("line").withColumnRenamed("kind", "template").withColumn("fields", F.lit(False)).select(columns).union(
        leaves.drop("line").join(general, ["size", "lead", "kind"]).select(columns))

    once = placed.groupBy(*form, "node").agg(F.min("doc_id").alias("doc"))
    common = few(
        once.groupBy(*form).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "node")).alias("first"))
        .where(F.col("n") >= F.when(F.col("fields"), field_docs).otherwise(min_docs))
        .select(*form, F.col("first.node").alias("keeper")))
    return placed.join(common, form).where("node <> keeper").groupBy("node").agg(
        F.collect_set("at").alias("drops"))


def templates(docs: DataFrame, depth: int = DEPTH, field_docs: int = FIELD_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(template, n_fields, n_texts, n_lines): the recurring templates with fields, written out.

    A position is a field where the lines that fit differ. A template that fits the lines of another one only is not
    listed apart.
    """
    lines = _lines(docs, depth, min_tokens)
    leaves = mixed_leaves(lines)
    kinds = kinds_of(leaves)
    general = generalised(kinds, depth).join(kinds, ["size", "lead", "kind"]).select(
        "size", "lead", "kind", F.xxhash64("subset", "kept").alias("template"), F.posexplode(tokens(F.col("line"))).alias("p", "token"))
    spots = general.groupBy("size", "lead", "template", "p").agg(
        F.min("token").alias("a"), F.max("token").alias("b"), F.bit_xor(F.xxhash64("kind")).alias("kinds"))
    written = spots.groupBy("size", "lead", "template").agg(
        F.first("kinds").alias("kinds"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("n_fields"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(FIELD)).alias("t")))), lambda x: x["t"]), " ").alias("text"))
    written = written.where("n_fields > 0").groupBy("size", "lead", "kinds", "text", "n_fields").agg(F.min("template").alias("template"))
    fits = general.select("size", "lead", "kind", "template").distinct().join(written, ["size", "lead", "template"])
    found = leaves.join(fits, ["size", "lead", "kind"]).groupBy("size", "lead", "template", F.col("text").alias("form"), "n_fields").agg(
        F.countDistinct("node").alias("n_texts"), F.count(F.lit(1)).alias("n_lines"))
    return found.where(F.col("n_texts") >= field_docs).select(F.col("form").alias("template"), "n_fields", "n_texts", "n_lines")


def _kept(docs: DataFrame, counts: bool, **options) -> DataFrame:
    names = ["n_lines", "n_dropped"] if counts else []
    node, drops, lines = free(docs, "node", "drops", "lines")
    gone = recurring(docs.select("doc_id", "text"), **options).select(F.col("node").alias(node), F.col("drops").alias(drops))
    # the lines stand twice in the expression, so the optimiser leaves their split in a step of its own
    own = docs.withColumn(node, row_key("text")).join(gone, node, "left").withColumn(lines, F.split("text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops), lambda i: F.get(lines, i))
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text")
    counted = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for c, n in zip((lines, drops), names)]
    gone = {n.lower() for n in names}
    return own.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone], *counted)


def without_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with text less its recurring lines; all other columns come back as they are.

    Null texts stay null, an empty text has one line; lines of fewer than three tokens always stay, and so do all lines
    of long texts that recur nowhere else. A text may become empty, its row stays. Repeated rows are alike. A null
    doc_id counts as the smallest one. Empty tables stay empty.
    """
    return _kept(docs, False, **options)


def with_line_counts(docs: DataFrame, **options) -> DataFrame:
    """``without_recurring_lines`` and the columns n_lines and n_dropped, 0 for a null text; the input's columns of these
    names are replaced."""
    return _kept(docs, True, **options)


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    return with_line_counts(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def sql(table: str = "documents", min_docs: int = MIN_DOCS, field_docs: int = FIELD_DOCS) -> str:
    """The text of every row after line dedup, as DuckDB SQL: common table expressions up to ``lined``."""
    subsets = ", ".join(f"({s})" for s in SUBSETS)
    return rf"""
src AS (SELECT *, row_number() OVER () AS rid FROM {table}),
cut AS (
  SELECT rid, doc_id, text, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ln
  FROM (SELECT *, string_split(regexp_replace(text, '[^ \t\r\n]*[0-9][^ \t\r\n]*', '<*>', 'g'), chr(10)) AS l
        FROM src WHERE text IS NOT NULL)),
tok AS (SELECT *, string_split_regex(trim(line, ' ' || chr(9) || chr(13)), '[ \t\r]+') AS t FROM cut),
leaf AS (SELECT *, len(t) AS size, t[1:{DEPTH}] AS lead FROM tok WHERE len(t) >= {MIN_TOKENS}),
many AS (SELECT size, lead FROM leaf GROUP BY ALL HAVING count(DISTINCT text) > 1 AND count(DISTINCT line) > 1),
kinds AS (SELECT DISTINCT size, lead, line, t[{DEPTH + 1}:] AS rest, size - {DEPTH} AS m FROM leaf JOIN many USING (size, lead) WHERE size > {DEPTH}),
gen AS (SELECT *, list_filter(rest, lambda x, i: ((subset >> ((i - 1) * {RUNS} // m)::INTEGER) & 1) = 1) AS kept
        FROM kinds CROSS JOIN (VALUES {subsets}) s(subset)),
fit AS (SELECT size, lead, line, subset || ':' || array_to_string(kept, ' ') AS template
        FROM gen WHERE len(kept) >= 2 AND 2 * len(kept) >= m AND len(kept) < m),
shared AS (SELECT size, lead, template FROM fit GROUP BY ALL HAVING count(DISTINCT line) > 1),
tmpl AS (
  SELECT rid, doc_id, text, ln, size, lead, '0:' || line AS template FROM leaf
  UNION ALL SELECT rid, doc_id, text, ln, size, lead, template FROM leaf JOIN fit USING (size, lead, line) JOIN shared USING (size, lead, template)),
common AS (SELECT size, lead, template, arg_min(text, (doc_id, md5(text))) AS keeper
           FROM tmpl GROUP BY ALL HAVING count(DISTINCT text) >= CASE WHEN template[1:2] = '0:' THEN {min_docs} ELSE {field_docs} END),
gone AS (SELECT rid, list(DISTINCT ln) AS drops
         FROM tmpl JOIN common USING (size, lead, template) WHERE text <> keeper GROUP BY rid),
lined AS (
  SELECT src.* EXCLUDE (rid, text), coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(len(drops), 0) AS n_dropped,
    CASE WHEN drops IS NULL THEN text
    ELSE array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(drops, i - 1)], chr(10)) END AS text
  FROM src LEFT JOIN gone USING (rid))"""


SQL = f"WITH {sql()} SELECT doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) AS text_sha256 FROM lined"
