"""Secret scans: a trigram inverted index proposes texts, the expressions verify them.

Each rule's expression gives a Boolean trigram query (``trigrams``).  The index
holds postings (trigram, document key) for the trigrams that some query names; the
postings of each branch are intersected by counting them per document, and a rule is
verified only in the documents that a branch of it proposes.  A rule without
mandatory trigrams (long hex numbers) scans every text.

Document keys only propose: rows that share a ``doc_id`` share proposals, and the
expression itself decides on each whole text.  Everything is DataFrame expressions.

Places of matches are prefix sums, taken block by block: the time of a text is linear in its
matches as far as it matters (100,000 in one text are no slower a match than 1,000).

Defined cases: a NULL text is an empty one and has no secrets; very long texts and texts of very many
matches are scanned whole, in one task; overlapping spans of
different rules are all reported and blanked as one; repeated rows give one result
each; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import field, let, packed, table, unpacked
from tapeloom.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of one group of a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: In the order in which spans at the same place are listed.
RULES = (
    Rule("assign", ASSIGN, group=2, least=12, base=True),
    # Runs are maximal, so the least length can stand in the expression.
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
BLANK = "[SECRET]"
#: Matches of one text that are added up one by one.
SCAN = 512
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id)


def postings(docs: DataFrame, trigrams: list[str], doc_id: Column, text: Column) -> DataFrame:
    """The inverted index: (trigram, key) for every listed trigram that a lower-cased text contains."""
    listed = F.array(*[F.lit(t) for t in trigrams])
    present = let(F.lower(text), lambda low: F.filter(listed, lambda t: F.contains(low, t)))
    return docs.where(text.isNotNull()).select(_key(doc_id).alias("key"), F.explode(present).alias("trigram"))


def proposals(docs: DataFrame, rules: tuple[Rule, ...], doc_id: Column, text: Column) -> DataFrame:
    """(key, kinds): the rules with trigrams of which some branch has all its postings in the document."""
    rows = [
        (rule.kind, number, trigram, len(branch))
        for rule in rules
        for number, branch in enumerate(trigram_query(rule.pattern))
        for trigram in sorted(branch)
    ]
    spark = docs.sparkSession
    queries = spark.createDataFrame(rows, "kind string, branch int, trigram string, needed int")  # as long as the rules
    index = postings(docs, sorted({row[2] for row in rows}), doc_id, text)
    found = index.join(F.broadcast(queries), "trigram").groupBy("key", "kind", "branch", "needed")
    met = found.agg(F.count_distinct("trigram").alias("met")).where("met = needed")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _scanned(values: Column, join: Callable[[Column, Column], Column], depth: int = 1) -> Column:
    """For every value of an array all values before it, joined (0 before the first).

    Array values are copied when they grow, so only blocks of ``SCAN`` values are scanned one by one:
    inside each block, and over the blocks' totals in the same way.
    """
    zero = F.lit(0).cast("bigint")

    def plain(xs: Column) -> Column:
        empty = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda done, x: F.struct(
            join(done["at"], x).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")
        )
        return F.aggregate(xs, empty, step, lambda done: done["out"])

    if depth == 0:
        return plain(values)

    def blockwise(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / SCAN).cast("int")), lambda b: F.slice(xs, b * SCAN + 1, SCAN))

        def joined(bs: Column) -> Column:
            totals = F.transform(bs, lambda b: F.aggregate(b, zero, join))
            return F.flatten(
                F.zip_with(bs, _scanned(totals, join, depth - 1), lambda b, at: F.transform(plain(b), lambda x: join(at, x)))
            )

        return F.when(F.size(xs) > SCAN, let(blocks, joined)).otherwise(plain(xs))

    return let(values, blockwise)


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of one rule: leftmost non-overlapping matches, those that are too short left out.

    A match starts where the matches before it and the pieces between them end.
    """
    take = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    held = take(rule.group) if rule.least else take(0)

    def sized(between: Column, matches: Column, groups: Column) -> Column:
        return F.transform(
            matches,
            lambda m, i: F.struct(
                F.length(F.get(between, i)).cast("bigint").alias("gap"),
                F.length(m).cast("bigint").alias("len"),
                (F.length(F.get(groups, i)) >= rule.least).alias("kept"),
            ),
        )

    def placed(items: Column, before: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(before, i) + m["gap"]
            fields = start.alias("start"), F.lit(rank).alias("rank"), (start + m["len"]).alias("end"), F.lit(rule.kind).alias("kind")
            return F.when(m["kept"], F.struct(*fields))

        return F.filter(F.transform(items, span), lambda s: s.isNotNull()).cast(_SPAN)

    pieces = F.split(text, rule.pattern, -1)
    items = let(pieces, lambda ps: let(take(0), lambda ms: let(held, lambda gs: sized(ps, ms, gs))))
    sums = lambda ms: _scanned(F.transform(ms, lambda m: m["gap"] + m["len"]), lambda a, x: a + x)
    spans = let(items, lambda ms: let(sums(ms), lambda before: placed(ms, before)))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(_SPAN))


def with_spans(
    docs: DataFrame, doc_id: Column, text: Column, rules: tuple[Rule, ...] = RULES, name: str = "spans"
) -> DataFrame:
    """Add the sorted spans (start, rank, end, kind), in code points, end exclusive."""
    proposed = proposals(docs, rules, doc_id, text).withColumnsRenamed({"key": "__key", "kinds": "__kinds"})
    joined = docs.withColumn("__own", _key(doc_id)).join(proposed, F.col("__own") == F.col("__key"), "left")
    body = F.coalesce(text, F.lit(""))
    found = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank, body)
        if trigram_query(rule.pattern):
            proposed_here = F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False))
            spans = F.when(proposed_here, spans).otherwise(F.array().cast(_SPAN))
        found.append(spans)
    return joined.withColumn(name, F.sort_array(F.concat(*found))).drop("__own", "__key", "__kinds")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def blanked(text: Column, spans: Column, blank: str = BLANK) -> Column:
    """The text with every run of overlapping spans replaced by ``blank``.

    A run starts at a span that starts where all before it have ended.  Finding a place in a text
    takes as long as the text before it, so runs are cut out of parts of ``SCAN`` runs.
    """

    def runs(ss: Column, ended: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(ss) - 1), lambda i: F.get(ss, i)["start"] >= F.get(ended, i))
        last = F.array_max(F.transform(ss, lambda s: s["end"]))
        return let(
            heads,
            lambda hs: F.transform(
                hs,
                lambda h, k: F.struct(
                    F.get(ss, h)["start"].cast("int").alias("start"),
                    F.coalesce(F.get(ended, F.get(hs, k + 1)), last).cast("int").alias("end"),
                ),
            ),
        )

    def cut(areas: Column) -> Column:
        """Each part runs from the end of the run before it to the end of its own last run."""
        end_of = lambda i: F.coalesce(F.get(areas, i)["end"], F.lit(0))

        def part(b: Column) -> Column:
            own = F.slice(areas, b * SCAN + 1, SCAN)
            begin = end_of(b * SCAN - 1)
            body = F.substr(text, begin + 1, end_of(F.least((b + 1) * SCAN, F.size(areas)) - 1) - begin)

            def pieces(rs: Column, whole: Column) -> Column:
                def piece(r: Column, k: Column) -> Column:
                    after = F.coalesce(F.get(rs, k - 1)["end"], begin) - begin
                    return F.concat(F.substr(whole, after + 1, r["start"] - begin - after), F.lit(blank))

                return F.array_join(F.transform(rs, piece), "")

            return let(own, lambda rs: let(body, lambda whole: pieces(rs, whole)))

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(areas) - 1) / SCAN).cast("int")), part)
        tail = F.substr(text, end_of(F.size(areas) - 1) + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), tail)

    ends = lambda ss: _scanned(F.transform(ss, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    areas = let(spans, lambda ss: let(ends(ss), lambda ended: runs(ss, ended)))
    return F.when(F.size(spans) > 0, let(areas, cut)).otherwise(text)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, and all spans."""
    rows = with_spans(docs.select("doc_id", "text"), F.col("doc_id"), F.col("text"))
    ranks = {rule.kind: rank for rank, rule in enumerate(RULES) if rule.base}

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")

    counts = [count(rank).alias(f"n_{kind}") for kind, rank in ranks.items()]
    base = F.filter("spans", lambda s: s["rank"] < len(ranks))
    return rows.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def without_secrets(docs: DataFrame) -> DataFrame:
    """All documents, their secrets blanked; ``n_chars`` follows the text where the table has it."""
    rows = with_spans(packed(docs), field("doc_id"), field("text"))
    rows = rows.withColumn("__text", blanked(field("text"), F.col("spans")))
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.size("spans") > 0
        new["n_chars"] = F.when(changed, F.length("__text").cast(kind)).otherwise(field("n_chars"))
    return unpacked(rows, docs.columns, **new)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every rule on every whole text, without an index."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    parts = []
    for rank, rule in enumerate(RULES):
        p = quoted(rule.pattern)
        parts.append(
            f"""SELECT row_id, {rank} AS rank, '{rule.kind}' AS kind, start, start + len AS stop FROM (
  SELECT row_id, length(ms[i]) AS len, length(gs[i]) AS held,
         CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) AS BIGINT)
         + coalesce(CAST(list_sum(list_transform(ms[1:i-1], lambda x: length(x))) AS BIGINT), 0) AS start
  FROM (SELECT row_id, ps, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT row_id, string_split_regex(body, {p}) AS ps, regexp_extract_all(body, {p}, 0) AS ms,
           regexp_extract_all(body, {p}, {rule.group}) AS gs FROM docs WHERE regexp_matches(body, {p}))))
WHERE held >= {rule.least}"""
        )
    union = "\nUNION ALL\n".join(parts)
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base
    )
    n_base = functools.reduce(lambda n, r: n + r.base, RULES, 0)
    line = "kind || ':' || start || ':' || stop"
    return f"""WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({union}),
found AS (SELECT row_id, {counts},
  sha256(coalesce(string_agg({line}, ',' ORDER BY start, rank, stop) FILTER (WHERE rank < {n_base}), '')) AS base_sha256,
  string_agg({line}, ',' ORDER BY start, rank, stop) AS spans FROM spans GROUP BY row_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)},
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (row_id)"""


ORACLE = _oracle()
