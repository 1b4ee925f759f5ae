"""Recurring lines dropped by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes down by its number of tokens and its first tokens to a leaf. Tokens that hold a
digit are variable and read as ``<*>`` on the way, so lines that differ in numbers, dates or addresses have one
template. Inside a leaf two templates are linked when their tokens agree on a large enough share of places, and a cluster is all that
links reach, so the order of lines plays no part. A cluster of templates that occurs in two documents or more
recurs: its lines stay in the document with the smallest id and are dropped from the others.

All links of a leaf are found, mostly without comparing all pairs. In a large group a few templates are compared with all, which makes one
cluster of most; only those outside of it go on. If they are still many: two templates that may differ in ``d`` places agree on one
of any ``d + 1`` runs of places, so the group is split by the tokens of each run, and its parts by runs of the places left, where that halves
the comparisons. A group that it does not help is compared pair by pair, spread over tasks.

What is shuffled: a few numbers per line; lines only where their leaf holds several templates. Counts are pre-aggregated, so one
very common line is one row per task. Joins on a leaf or template are plain equi-joins, which adaptive
execution splits where a key is frequent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lmprep.cluster import once
from lmprep.llm.components import connected_components, more_links
from lmprep.llm.store import written

VARIABLE = "<*>"
#: Templates outside a group's largest cluster that are compared with the whole group at once, for each run it can be split by.
FEW = 32
#: Templates compared with the whole of a larger group first, and the rows of a group that one task compares with them.
HUBS, ROWS = 8, 1024


@dataclass(frozen=True)
class Tree:
    """``lead``: tokens on the path below the token count; ``agree``: share of equal places that links templates; ``min_tokens``:
    shorter lines are left alone, they recur by chance; ``min_joined``: shorter lines recur only by their exact template."""

    lead: int = 3
    agree: float = 0.8
    min_tokens: int = 5
    min_joined: int = 10


def _tokens(line: Column) -> Column:
    """White-space separated tokens of a line, variable ones replaced."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*", VARIABLE)).otherwise(line)
    return F.split(F.btrim(masked, F.lit(" \t\x0b\f\r")), r"[ \t\x0B\f\r]+")


def _lines(docs: DataFrame, tree: Tree, id_col: str, text: str) -> DataFrame:
    """doc, pos, size, leaf and template of every line that is long enough."""
    known = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("text")).where(
        "doc IS NOT NULL AND text IS NOT NULL"
    )
    exploded = known.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    tokens = exploded.select("doc", "pos", F.explode(F.array(_tokens(F.col("line")))).alias("tokens"))
    return tokens.where(F.size("tokens") >= tree.min_tokens).select(
        "doc", "pos",
        F.size("tokens").alias("size"),
        F.xxhash64(F.size("tokens"), F.slice("tokens", 1, tree.lead)).alias("leaf"),
        F.xxhash64("tokens").alias("template"),
        "tokens",
    )


def _same(a: str, b: str) -> Column:
    """Places on which two arrays of one length agree."""
    equal = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda total, x: total + x)


def _run(left: Column, part: Column, parts: Column) -> tuple[Column, Column]:
    """Of ``parts`` nearly equal runs of ``left`` the one numbered ``part``: how many places stand before it, and its length."""
    before = F.floor(part * F.size(left) / parts).cast("int")
    return before, F.floor((part + 1) * F.size(left) / parts).cast("int") - before


def _without(left: Column, part: Column, parts: Column) -> Column:
    before, length = _run(left, part, parts)
    return F.concat(F.slice(left, F.lit(1), before), F.slice(left, before + length + 1, F.size(left)))


def _sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each group its number ``n`` of templates, its largest cluster ``main`` and the number ``u`` of templates outside; none of one cluster."""
    clusters = rows.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    sized = clusters.groupBy(*keys).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
    return sized.select(*keys, "n", F.col("main.root").alias("main"), (F.col("n") - F.col("main.n")).alias("u")).where("u > 0")


def _split(large: DataFrame, tree: Tree, parts: Column) -> DataFrame:
    """Rows of the parts of groups, one for each run of the places left; ``whole`` is the group."""
    none = F.expr("cast(array() AS array<int>)")
    places = F.when(F.size("tokens") > tree.lead, F.sequence(F.lit(tree.lead + 1), F.size("tokens"))).otherwise(none)
    left = F.aggregate("path", places, lambda rest, part: _without(rest, part, parts))
    rows = large.select("key", "template", "root", "path", "tokens", parts.alias("parts"), once(left).alias("left"))
    # where no more places are left than may differ, all are linked to each of those compared with all
    rows = rows.where(F.size("left") >= F.col("parts")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    before, length = _run(F.col("left"), F.col("part"), F.col("parts"))
    run = F.transform(F.slice("left", before + 1, length), lambda place: F.get("tokens", place - 1))
    return rows.select(
        F.col("key").alias("whole"), F.xxhash64("key", "part", run).alias("key"), "template", "root", F.concat("path", F.array("part")).alias("path")
    )


def linked(spelled: DataFrame, tree: Tree = Tree(), few: int = FEW) -> DataFrame:
    """(template, root) of every template linked to another of its leaf; ``root`` is the least template that links reach.

    ``spelled`` has a row (leaf, template, tokens) per template. Links inside what is one cluster already are left out, all others are found.
    """
    words = spelled.select("template", "tokens")
    alike = F.ceil(F.lit(tree.agree) * F.size("tokens")).cast("int")
    parts = F.size("tokens") - alike + 1
    # a group agrees on its leaf's first tokens and on the runs that ``path`` numbers
    open_ = spelled.select(
        F.col("leaf").alias("key"), "template", F.col("template").alias("root"), F.expr("cast(array() AS array<int>)").alias("path"), F.lit(False).alias("every")
    )
    roots = None
    while True:
        group = open_.join(_sizes(open_, "key"), "key").join(words, "template")
        group = group.withColumn("every", F.col("every") | (F.col("u") <= few * parts)).withColumn("outside", F.expr("root <> main"))
        group = written(group, "group")
        large = group.where("NOT every")
        own = F.struct("template", "root", "outside", "tokens").alias("hub")
        hubs = group.where("every AND outside").select("key", "n", "every", own).union(
            large.groupBy("key", "n", "every", F.pmod(F.xxhash64("key", "template"), F.lit(HUBS)).alias("part")).agg(F.min_by(own, "template").alias("hub")).drop("part")
        )
        tasks = F.ceil(F.col("n") / ROWS).cast("int")
        hubs = hubs.select("key", F.col("every").alias("hub_every"), "hub", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"))
        near = group.withColumn("task", F.pmod(F.hash("template"), tasks)).join(hubs, ["key", "task"])
        near = near.where("root <> hub.root AND NOT (hub_every AND outside AND template > hub.template)")
        near = near.where(_same("tokens", "hub.tokens") >= alike)
        links = written(near.select(F.col("template").alias("a"), F.col("hub.template").alias("b")).distinct(), "links")
        roots = connected_components(links) if roots is None else more_links(roots, links)
        if large.isEmpty():
            return roots.select(F.col("node").alias("template"), "root")
        roots = written(roots, "roots")
        known = roots.select(F.col("node").alias("template"), F.col("root").alias("top"))
        large = large.drop("n", "u", "main").join(known, "template", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
        large = written(large.join(_sizes(large, "key").select("key", "n", "u"), "key"), "large")
        pieces = written(_split(large.where(F.col("u") > few * parts), tree, parts), "pieces")
        after = _sizes(pieces, "whole", "key").groupBy("whole").agg(F.sum(F.col("n") * F.col("u")).alias("cost"))
        wholes = large.groupBy("key").agg(F.max(F.col("n") * F.col("u")).alias("cost"), F.max(F.col("u") > few * parts).alias("many"))
        kept = wholes.alias("w").join(after.alias("a"), F.expr("w.key = a.whole"), "left").select(
            "key", F.expr("many AND coalesce(a.cost, 0) * 2 <= w.cost").alias("halved")
        )
        kept = written(kept, "kept")
        stay = large.join(kept.where("NOT halved").select("key"), "key").select("key", "template", "root", "path", F.lit(True).alias("every"))
        go = pieces.join(kept.where("halved").select(F.col("key").alias("whole")), "whole").select("key", "template", "root", "path", F.lit(False).alias("every"))
        open_ = written(stay.union(go), "open")


def dropped_lines(docs: DataFrame, tree: Tree = Tree(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos) of the lines to drop, each once; ``pos`` counts from 0."""
    lines = written(_lines(docs, tree, id_col, text).drop("tokens"), "lines")
    templates = written(
        lines.groupBy("leaf", "size", "template").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last")),
        "templates",
    )
    leaves = templates.where(F.col("size") >= tree.min_joined).groupBy("leaf").agg(F.count("*").alias("kinds")).where("kinds > 1")
    contested = templates.join(leaves, "leaf").groupBy("first.doc").agg(
        F.collect_list(F.struct("first.pos", "leaf", "template")).alias("wanted")
    )
    wanted = (
        docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("text"))
        .join(contested, "doc")
        .select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    )
    spelled = wanted.select("w.leaf", "w.template", _tokens(F.get("lines", F.col("w.pos"))).alias("tokens"))
    # rows that repeat a document's id may hold another text: the spelling must be that of the template
    spelled = spelled.where(F.xxhash64("tokens") == F.col("template")).dropDuplicates(["leaf", "template"])
    joined = linked(written(spelled, "spelled"), tree)
    clusters = templates.join(joined, "template", "left").select(
        "template", F.coalesce("root", "template").alias("cluster"), F.col("first.doc").alias("first"), "last"
    )
    recurring = clusters.groupBy("cluster").agg(F.min("first").alias("owner"), F.max("last").alias("last")).where("owner < last")
    owners = clusters.join(recurring.select("cluster", "owner"), "cluster").select("template", "owner")
    return lines.join(owners, "template").where("doc > owner").select("doc", "pos").distinct()


def drop_recurring(
    docs: DataFrame, tree: Tree = Tree(), id_col: str = "doc_id", text: str = "text", emptied: str = "keep"
) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and columns ``n_lines`` and ``n_dropped``.

    Rows keep their number and their columns, but for any of these two names, which give way to ours. Texts of any
    number of lines take time in proportion; an empty table stays empty. A null text or a null id leaves the row as it is (0 dropped; a null text
    has 0 lines). Rows that repeat an id are one document: lines that they share do not recur by that. With ``emptied="drop"`` a row goes
    if lines were dropped and nothing but white space is left.
    """
    gone = dropped_lines(docs, tree, id_col, text).groupBy(F.col("doc").alias("_gone_doc")).agg(
        F.collect_set("pos").alias("_gone")
    )
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the row travels as one struct, so no column of ours can be taken for one of its own
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    joined = row.join(gone, F.col(f"_row.`{id_col}`") == F.col("_gone_doc"), "left")
    whole = F.col(f"_row.`{text}`")
    joined = joined.select("_row", "_gone", once(F.split(whole, "\n")).alias("_old"))
    old = F.col("_old")
    # a difference of positions is taken by hash, in time linear in the lines
    kept = F.array_except(F.sequence(F.lit(0), F.size(old) - 1), F.col("_gone"))
    new = F.array_join(F.transform(kept, lambda at: F.get(F.col("_old"), at)), "\n")
    hit = F.col("_gone").isNotNull() & whole.isNotNull()
    out = joined.select(
        *((F.when(hit, new).otherwise(whole) if c == text else F.col(f"_row.`{c}`")).alias(c) for c in columns),
        F.when(whole.isNull(), 0).otherwise(F.size(old)).cast("long").alias("n_lines"),
        F.when(hit, F.size(F.filter("_gone", lambda p: p < F.size(old)))).otherwise(0).cast("long").alias("n_dropped"),
    )
    if emptied == "drop":
        out = out.where((F.col("n_dropped") == 0) | F.col(f"`{text}`").rlike(r"[^ \t\x0B\f\r\n]"))
    return out


#: The same in SQL, templates and leaves spelled out instead of hashed.
SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), tokens AS (
  SELECT doc, pos, regexp_split_to_array(trim(regexp_replace(line, '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'),
    ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \t\x0B\f\r]+') AS tokens
  FROM lines
), long AS (
  SELECT doc, pos, tokens, len(tokens) AS size, tokens[1:3] AS lead FROM tokens WHERE len(tokens) >= 5
), templates AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY tokens) AS id
  FROM (SELECT size, lead, tokens, min(doc) AS first, max(doc) AS last FROM long GROUP BY ALL)
), links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM templates a JOIN templates b ON a.size = b.size AND a.lead = b.lead AND a.id <> b.id
  WHERE a.size >= 10 AND len(list_filter(range(1, a.size + 1), lambda i: a.tokens[i] = b.tokens[i])) >= ceil(0.8 * a.size)
), reached (id, root) AS (
  SELECT id, id FROM templates UNION SELECT b, root FROM reached JOIN links ON id = a WHERE root < b
), clusters AS (
  SELECT tokens, first, last, cluster FROM templates JOIN (SELECT id, min(root) AS cluster FROM reached GROUP BY id) USING (id)
), recurring AS (
  SELECT cluster, min(first) AS owner FROM clusters GROUP BY cluster HAVING min(first) < max(last)
), gone AS (
  SELECT doc, list(DISTINCT pos) AS gone
  FROM long l JOIN clusters c ON l.tokens = c.tokens JOIN recurring r ON c.cluster = r.cluster
  WHERE doc > owner GROUP BY doc
)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    list_transform(list_filter(range(len(string_split(text, chr(10)))), lambda i: NOT list_contains(gone, i)),
      lambda i: string_split(text, chr(10))[i + 1]), chr(10)) END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  CASE WHEN gone IS NULL THEN 0 ELSE len(gone) END AS n_dropped
FROM documents LEFT JOIN gone ON doc_id = doc
"""
