"""The ten operators as queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_pairs, decontaminate, jaccard_join, licenses, near_vectors, packing, sharding, token_counts, toxicity, url_filter
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER, with_ids=False)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.written_shards(sharding.external_shuffle(docs, shards=16, carry=tuple(docs.columns), stable=True))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs, net)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train_on_rules(pages))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_tables(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_pairs.format_pairs(chat_pairs.pair_by_opening(table(spark, sf_dir, "conversations")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_near_vectors, op3_sharding, op4_toxicity, op5_url_filter, op6_licenses, op7_token_counts, op8_chat_pairs, op9_decontamination, op10_jaccard_join)}


def _licenses_sql() -> str:
    """The same cuts, normal forms and sequences in SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    columns, counts = [], []
    for k, cut in enumerate(licenses.CUTS):
        parts, _ = licenses._split_known(cut)
        case = " ".join(f"WHEN {quoted(p)} THEN ';{n};'" for p, n in parts.items())
        forms = f"list_transform(string_split_regex(coalesce(text, ''), {quoted(cut)}), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), ' '))"
        columns.append(f"array_to_string(list_transform(list_filter({forms}, lambda s: s <> ''), lambda s: CASE s {case} ELSE ';0;' END), '') AS ids{k}")
    for rule, lic, ids in licenses.RULES:
        per = [" + ".join(f"(length(ids{k}) - length(replace(ids{k}, '{p}', ''))) // {len(p)}" for p in licenses.sequences(ids, cut)) for k, cut in enumerate(licenses.CUTS)]
        counts.append(f"SELECT doc_id, '{rule}' AS rule, '{lic}' AS license, CAST(greatest({', '.join(per)}) AS BIGINT) AS n_matches FROM cut")
    return f"WITH cut AS (SELECT doc_id, {', '.join(columns)} FROM documents) SELECT * FROM ({' UNION ALL '.join(counts)}) WHERE n_matches > 0"


_SHINGLES = """
{name}_words AS (SELECT {id} AS id, {words} AS w FROM {table}),
{name} AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                  WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ') || '>'] ELSE [] END) AS s
  FROM {name}_words)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(pattern: str) -> str:
    return f"regexp_extract_all({_LOWER}, '{pattern}')"


def _contained_sql() -> str:
    words = _words(r"[^\x00-\x2F:-@\[-`{-\x7F]+")
    d = _SHINGLES.format(name="d", id="doc_id", table="documents", words=words)
    b = _SHINGLES.format(name="b", id="item_id", table="benchmark", words=words)
    return f"""WITH {d}, {b},
size AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(size.n) AS n_item, count(*) AS n_shared
FROM b JOIN d ON b.s = d.s JOIN size ON size.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(size.n)"""


def _jaccard_sql() -> str:
    """Exact components; the recursion carries labels down until they settle."""
    d = _SHINGLES.format(name="d", id="doc_id", table="documents", words=_words(r"[^\x20\x09-\x0D]+"))
    return f"""WITH RECURSIVE {d},
size AS (SELECT id, count(*) AS n FROM d GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM d x JOIN d y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM pairs JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
part AS (SELECT id, min(other) AS least FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM documents LEFT JOIN size ON size.id = doc_id LEFT JOIN part ON part.id = doc_id"""


def _pairing_rounds_sql() -> str:
    """Round after round, what has no pair yet is paired within wider runs of ids, until one run holds all ids."""
    bits, steps = chat_pairs.BUCKET.bit_length() - 1, ["r0 AS (SELECT conv_id, turns[1].role AS role, turns[1].text AS text, CAST(NULL AS BIGINT) AS head FROM talks)"]
    for k in range(1, 63 // bits + 2):
        run = f"conv_id >> {bits}" if k == 1 else "0" if bits * k > 63 else f"CASE WHEN (high >> {bits * (k - 1)}) - (low >> {bits * (k - 1)}) < {chat_pairs.BUCKET} THEN 0 ELSE conv_id >> {bits * k} END"
        steps.append(
            f"r{k} AS (SELECT conv_id, role, text, CASE WHEN head IS NOT NULL THEN head WHEN row_number() OVER w % 2 = 0 THEN lag(conv_id) OVER w WHEN lead(conv_id) OVER w IS NOT NULL THEN conv_id END AS head "
            f"FROM r{k - 1}, span WINDOW w AS (PARTITION BY head IS NULL, role, text, {run} ORDER BY conv_id))"
        )
    steps.append(f"paired_ids AS (SELECT min(conv_id) AS chosen, CASE WHEN count(*) > 1 THEN max(conv_id) END AS rejected FROM r{k} GROUP BY coalesce(head, conv_id))")
    return ",\n".join(steps)


def _chat_sql() -> str:
    text = "replace(t.text, '<|im_', '<| im_')"
    render = lambda turns: f"array_to_string(list_transform({turns}, lambda t: '<|im_start|>' || t.role || chr(10) || {text} || '<|im_end|>' || chr(10)), '')"
    size = f"12 + length(t.role) + 1 + length({text}) + 10 + 1"
    before = lambda turns: f"coalesce(list_sum(list_transform({turns}[:i - 1], lambda t: {size})), 0)"
    mask = lambda turns: (
        f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'), "
        f"lambda i: CAST(CAST({before(turns)} + 13 + length({turns}[i].role) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST({before(turns)} + 13 + length({turns}[i].role) + length(replace({turns}[i].text, '<|im_', '<| im_')) + 10 AS BIGINT) AS VARCHAR)), ',')"
    )
    return f"""WITH talks AS (
  SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
span AS (SELECT min(conv_id) AS low, max(conv_id) AS high FROM talks),
{_pairing_rounds_sql()},
paired AS (
  SELECT x.conv_id AS chosen_id, coalesce(y.conv_id, x.conv_id) AS rejected_id, x.turns AS a,
         coalesce(y.turns, x.turns[:coalesce(list_max(list_filter(range(1, len(x.turns) + 1), lambda i: x.turns[i].role = 'assistant')) - 1, len(x.turns))]) AS b
  FROM paired_ids JOIN talks x ON x.conv_id = chosen LEFT JOIN talks y ON y.conv_id = rejected),
shared AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: i > len(a) OR i > len(b) OR a[i].role <> b[i].role OR a[i].text <> b[i].text)) - 1, len(a)) AS n FROM paired),
parts AS (SELECT chosen_id, rejected_id, n, a[:n] AS p, a[n + 1:] AS c, b[n + 1:] AS r FROM shared)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS prompt_turns, {render("p")} AS prompt, {render("c")} AS chosen, {render("r")} AS rejected, {mask("c")} AS chosen_mask, {mask("r")} AS rejected_mask
FROM parts"""


def oracle() -> dict[str, str]:
    return {"op6_licenses": _licenses_sql(), "op8_chat_pairs": _chat_sql(), "op9_decontamination": _contained_sql(), "op10_jaccard_join": _jaccard_sql()}
