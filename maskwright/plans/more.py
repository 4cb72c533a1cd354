"""Further operators over the driver's tables, with equivalent SQL: pages are orders, boxes their lines, turns events or conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry, lifecycle, postcheck, sessions
from .registry import ORACLE_SQL, QUERIES, query, read

__all__ = ["ORACLE_SQL", "QUERIES"]  # those of the registry and of this module

_BOX = "l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS id, CAST(l_quantity AS BIGINT) AS x0, CAST(l_linenumber AS BIGINT) AS y0, CAST(l_quantity + 6 + l_linenumber AS BIGINT) AS x1, CAST(l_linenumber + 3 AS BIGINT) AS y1, l_returnflag AS kind, l_discount * 10 AS score, l_linestatus AS text"
_SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
KEY = ["doc"]


def boxes(spark, sf_dir, kind: str | None = None):
    """Lines of orders as boxes on pages."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = read(spark, sf_dir, "lineitem").withColumn("id", number)
    rows = rows if kind is None else rows.where(F.col("l_returnflag") == kind)
    q = F.col("l_quantity")
    return rows.select(F.col("l_orderkey").alias("doc"), "id", q.cast("long").alias("x0"), F.col("l_linenumber").cast("long").alias("y0"), (q + 6 + F.col("l_linenumber")).cast("long").alias("x1"), (F.col("l_linenumber") + 3).cast("long").alias("y1"), (F.col("l_discount") * 10).alias("score"), F.col("l_linestatus").alias("text"))


@query(f"WITH b AS (SELECT {_BOX} FROM lineitem) SELECT a.doc, a.id AS inner_id, b.id AS outer_id FROM b a JOIN b ON a.doc = b.doc AND a.kind = 'N' AND b.kind = 'R' WHERE {_SHARED} >= 0.6 * ((a.x1 - a.x0) * (a.y1 - a.y0))")
def box_containment(spark, sf_dir):
    """Boxes that lie in another to six tenths of their area."""
    return geometry.contained(boxes(spark, sf_dir, "N"), boxes(spark, sf_dir, "R"), KEY)


@query(
    f"WITH b AS (SELECT {_BOX} FROM lineitem), p AS (SELECT a.doc, b.id AS rect_id, a.id, a.text, a.x0, (a.y0 + a.y1) / 2 AS my FROM b a JOIN b ON a.doc = b.doc AND a.kind <> 'A' AND b.kind = 'A' AND (a.x0 + a.x1) / 2 >= b.x0 AND (a.x0 + a.x1) / 2 < b.x1 AND (a.y0 + a.y1) / 2 >= b.y0 AND (a.y0 + a.y1) / 2 < b.y1) SELECT doc, rect_id, CAST(row_number() OVER (PARTITION BY doc, rect_id ORDER BY floor(my), x0, id) AS INT) AS place, text FROM p"
)
def text_in_rect(spark, sf_dir):
    """Words in a selection, in reading order."""
    words = boxes(spark, sf_dir, "N").unionByName(boxes(spark, sf_dir, "R"))
    return geometry.text_in_rect(words, boxes(spark, sf_dir, "A"), KEY)


@query(
    f"WITH b AS (SELECT {_BOX} FROM lineitem), poor AS (SELECT * FROM b a WHERE kind = 'N' AND score < 0.8 AND NOT EXISTS (SELECT 1 FROM b WHERE b.kind = 'R' AND b.doc = a.doc AND {_SHARED} >= 0.6 * ((a.x1 - a.x0) * (a.y1 - a.y0)))) SELECT doc, id, CAST(row_number() OVER (PARTITION BY doc ORDER BY y0, x0, id) AS INT) AS number FROM poor"
)
def unreadable_lines(spark, sf_dir):
    """Poorly read lines outside regions, numbered down the page."""
    lines = boxes(spark, sf_dir, "N").withColumn("text", F.lit("some words"))
    return geometry.unreadable_lines(lines, boxes(spark, sf_dir, "A").limit(0), boxes(spark, sf_dir, "R"), KEY)


@query(f"WITH b AS (SELECT {_BOX} FROM lineitem) SELECT a.doc, a.id, a.x0, a.x1 FROM b a WHERE a.kind <> 'A' AND NOT EXISTS (SELECT 1 FROM b WHERE b.kind = 'A' AND b.doc = a.doc AND {_SHARED} > 0)")
def sealed_words(spark, sf_dir):
    """Words that no sealed area touches."""
    words = boxes(spark, sf_dir, "N").unionByName(boxes(spark, sf_dir, "R")).withColumn("page", F.lit(1))
    areas = boxes(spark, sf_dir, "A").withColumn("page", F.lit(None).cast("int"))
    return geometry.sealed(words, areas, ["doc", "page"]).select("doc", "id", "x0", "x1")


@query(f"WITH b AS (SELECT {_BOX} FROM lineitem) SELECT a.doc, b.id AS match_id, a.id // 3 AS line, min(a.x0) AS x0, min(a.y0) AS y0, max(a.x1) AS x1, max(a.y1) AS y1 FROM b a JOIN b ON a.doc = b.doc AND b.kind = 'R' AND a.id >= b.id AND a.id < b.id + 3 GROUP BY ALL")
def match_rectangles(spark, sf_dir):
    """Characters of matches as one rectangle per line."""
    all_ = boxes(spark, sf_dir)
    chars = all_.withColumn("pos", F.col("id")).withColumn("line", F.floor(F.col("id") / 3).cast("int"))
    matches = boxes(spark, sf_dir, "R").select("doc", "id", F.col("id").alias("start"), (F.col("id") + 3).alias("end"))
    return geometry.match_rectangles(chars, matches, KEY)


@query(
    f"WITH b AS (SELECT {_BOX} FROM lineitem) SELECT a.doc, a.id AS region_id, b.id AS image_id, least(greatest((a.x0 - b.x0) * 100 / (b.x1 - b.x0), 0.0), 100.0) AS x0, least(greatest((a.y0 - b.y0) * 100 / (b.y1 - b.y0), 0.0), 100.0) AS y0, least(greatest((a.x1 - b.x0) * 100 / (b.x1 - b.x0), 0.0), 100.0) AS x1, least(greatest((a.y1 - b.y0) * 100 / (b.y1 - b.y0), 0.0), 100.0) AS y1 FROM b a JOIN b ON a.doc = b.doc AND a.kind = 'R' AND b.kind = 'A' AND {_SHARED} > 0"
)
def projected_regions(spark, sf_dir):
    """Regions in the pixels of the images they touch."""
    images = boxes(spark, sf_dir, "A").withColumn("width", F.lit(100)).withColumn("height", F.lit(100))
    return geometry.project_regions(boxes(spark, sf_dir, "R"), images, KEY)


@query(
    f"WITH RECURSIVE b AS (SELECT {_BOX} FROM lineitem), e AS (SELECT a.doc, a.id AS p, b.id AS q FROM b a JOIN b ON a.doc = b.doc AND a.id <> b.id AND {_SHARED} > 0), reach(doc, id, other) AS (SELECT doc, id, id FROM b UNION SELECT reach.doc, reach.id, e.q FROM reach JOIN e ON e.doc = reach.doc AND e.p = reach.other), r AS (SELECT doc, id, min(other) AS root FROM reach GROUP BY doc, id) SELECT r.doc, r.root, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r JOIN b USING (doc, id) GROUP BY r.doc, r.root"
)
def united_regions(spark, sf_dir):
    """Overlapping detections as one extent."""
    return geometry.united(boxes(spark, sf_dir), KEY)


@query()
def kept_regions(spark, sf_dir):
    """Greedy suppression of overlapping detections."""
    return geometry.suppressed(boxes(spark, sf_dir), KEY)


@query()
def tile_groups(spark, sf_dir):
    """Images cut into tiles."""
    return geometry.tile_groups(boxes(spark, sf_dir), KEY)


@query(
    "WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS id, l_returnflag AS kind, l_quantity AS p, l_tax * 100 AS q FROM lineitem), d AS (SELECT a.doc, a.id, b.id AS match_id, (abs(a.p - b.p) + abs(a.q - b.q)) / 2 AS distance FROM s a JOIN s b ON a.doc = b.doc AND a.kind = 'R' AND b.kind = 'N'), r AS (SELECT *, lead(distance) OVER w AS next, row_number() OVER w AS place FROM d WINDOW w AS (PARTITION BY doc, id ORDER BY distance, match_id)) SELECT doc, id, match_id, distance FROM r WHERE place = 1 AND distance <= 20.0 AND (next IS NULL OR next - distance >= 2.0)"
)
def signature_matches(spark, sf_dir):
    """Nearest known image with a margin over the runner-up."""
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), "l_returnflag", F.array(F.col("l_quantity"), F.col("l_tax") * 100).alias("signature"))
    return geometry.nearest_signature(s.where("l_returnflag = 'R'"), s.where("l_returnflag = 'N'"), KEY)


@query("SELECT user_id, count(*) AS calls, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS total_tokens, max_by(event_type, event_id) AS last_event_type FROM events GROUP BY user_id")
def turn_usage(spark, sf_dir):
    """Totals and the last call of each turn."""
    calls = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor("value").cast("long").alias("tokens"))
    return sessions.turn_usage(calls, "user_id", "event_id", ("tokens",), "event_type")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_artifacts(spark, sf_dir):
    """One row of each path of a turn."""
    return sessions.latest_artifacts(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT conv_id, role, string_agg(coalesce(text, ''), '' ORDER BY turn) AS whole, count(*) AS pieces FROM conversations GROUP BY conv_id, role")
def accumulated_fragments(spark, sf_dir):
    """Fragments joined in order."""
    return sessions.accumulated(read(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text")


@query(
    "WITH u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 500 = 0 THEN 'admin' ELSE 'user' END AS role FROM customer), m AS (SELECT s_suppkey AS model_id FROM supplier), a AS (SELECT c_custkey AS user_id, c_nationkey AS model_id FROM customer) SELECT DISTINCT user_id, model_id FROM (SELECT user_id, model_id FROM u, m WHERE role = 'admin' UNION ALL SELECT user_id, model_id FROM a JOIN m USING (model_id) JOIN u USING (user_id) WHERE role <> 'admin' UNION ALL SELECT user_id, 1 FROM u WHERE role <> 'admin')"
)
def visible_models(spark, sf_dir):
    """Allowed models and the default; administrators see all."""
    c = read(spark, sf_dir, "customer")
    users = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 500 == 0, "admin").otherwise("user").alias("role"))
    models = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model_id"))
    allowed = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("model_id"))
    return sessions.visible_models(users, models, allowed, 1)


@query("WITH v AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events) SELECT user_id, event_id, event_type, CAST(version AS INT) AS version FROM v WHERE version <= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC) = 1")
def registry_as_of(spark, sf_dir):
    """The state each scope had at version three."""
    v = sessions.versioned(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return sessions.as_of(v, "user_id", "version", F.lit(3))


@query("SELECT conv_id, turn, 'late' AS subscriber, text FROM conversations WHERE turn > 1")
def replayed_turns(spark, sf_dir):
    """What a subscriber who saw the first turns still has to see."""
    c = read(spark, sf_dir, "conversations")
    late = c.select("conv_id", F.lit("late").alias("subscriber"), F.lit(1).alias("position")).distinct()
    return sessions.replay(c, late, "conv_id", "turn").select("conv_id", "turn", "subscriber", "text")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE OR event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def expired_rows(spark, sf_dir):
    """Rows past the lifetime of their kind."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = events.agg(F.max("ts").alias("now"))
    return sessions.expired(events.crossJoin(F.broadcast(newest)), "event_type", "ts", F.col("now"), {"click": 30, "view": 1440}).select("event_id")


@query("SELECT p_partkey, CASE WHEN try_cast(p_brand AS DOUBLE) IS NOT NULL THEN least(greatest(try_cast(p_brand AS DOUBLE), 0.0), 2.0) END AS word, least(greatest(CAST(p_size AS DOUBLE), 5.0), 30.0) AS size FROM part")
def clamped_parameters(spark, sf_dir):
    """Parameters kept in range, words dropped."""
    return read(spark, sf_dir, "part").select("p_partkey", sessions.clamped(F.col("p_brand"), 0, 2).alias("word"), sessions.clamped(F.col("p_size").cast("string"), 5, 30).alias("size"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f', round(n / 1024.0::DOUBLE, 1)) || ' KB' END AS size, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE printf('%.1f', round(n / 1000.0::DOUBLE, 1)) || 'k' END AS compact FROM (SELECT doc_id, n_chars AS n FROM documents WHERE n_chars < 900000)")
def figures_as_text(spark, sf_dir):
    """Section 2.11: sizes and counts as text."""
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").where(n < 900000).select("doc_id", sessions.size_text(n).alias("size"), sessions.compact_int(n).alias("compact"))


_SPANS = "SELECT l_orderkey AS doc_id, l_returnflag AS label, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity + l_linenumber AS BIGINT) AS e FROM lineitem"


@query(
    f"WITH x AS (SELECT DISTINCT * FROM ({_SPANS})), f AS (SELECT * FROM x WHERE label = 'N'), k AS (SELECT * FROM x WHERE label = 'R') SELECT doc_id, label, s AS start, e AS end, false AS forced FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = f.doc_id AND f.s < k.e AND k.s < f.e AND f.e - f.s <= k.e - k.s) UNION ALL SELECT doc_id, label, s, e, true FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE k.doc_id = f.doc_id AND f.s < k.e AND k.s < f.e AND f.e - f.s > k.e - k.s)"
)
def forced_spans(spark, sf_dir):
    """Known values win over found ones unless those are longer."""
    q = F.col("l_quantity")
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), q.cast("long").alias("start"), (q + F.col("l_linenumber")).cast("long").alias("end")).distinct()
    return lifecycle.forced_spans(x.where("label = 'N'"), x.where("label = 'R'"), "doc_id")


@query(
    "WITH m AS (SELECT o_orderkey AS doc_id, o_custkey % 50 AS ms, o_custkey % 50 + 12 AS me, '[' || o_orderstatus || '_1]' AS placeholder FROM orders), g AS (SELECT o_orderkey AS doc_id, n AS segment, n * 8 AS ss, n * 8 + 8 AS se FROM orders, range(0, 8) r(n)), p AS (SELECT * FROM m JOIN g USING (doc_id) WHERE ms < se AND ss < me) SELECT doc_id, segment, greatest(ms, ss) - ss AS start, least(me, se) - ss AS end, CASE WHEN row_number() OVER (PARTITION BY doc_id, ms, me ORDER BY ss, segment) = 1 THEN placeholder ELSE '' END AS replacement FROM p"
)
def projected_matches(spark, sf_dir):
    """A match spread over the segments it touches."""
    at = F.col("o_custkey") % 50
    m = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), at.alias("start"), (at + 12).alias("end"), F.concat(F.lit("["), "o_orderstatus", F.lit("_1]")).alias("placeholder"))
    n = F.col("segment")
    g = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("segment")).select("doc_id", "segment", (n * 8).alias("start"), (n * 8 + 8).alias("end"))
    return lifecycle.projected_matches(m, g, "doc_id")


@query("SELECT o_orderstatus, o_orderkey, CAST(place AS INT) AS place, truncated FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderstatus) > 100 AS truncated FROM orders) WHERE place <= 100")
def sheet_preview(spark, sf_dir):
    """The first rows of each sheet."""
    return lifecycle.preview(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", 100).select("o_orderstatus", "o_orderkey", "place", "truncated")


@query("WITH k AS (SELECT DISTINCT lower(n_name) AS key, '[ORG_' || n_nationkey || ']' AS placeholder FROM nation) SELECT 's' AS sheet, CAST(c_custkey AS INT) AS row, 1 AS col, placeholder FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN k ON key = lower(n_name)")
def whole_cells(spark, sf_dir):
    """Cells whose whole value is known."""
    n = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    cells = c.select(F.lit("s").alias("sheet"), F.col("c_custkey").cast("int").alias("row"), F.lit(1).alias("col"), F.concat(F.lit(" "), F.lower("n_name"), F.lit("  ")).alias("text"))
    known = n.select(F.col("n_name").alias("surface"), F.concat(F.lit("[ORG_"), F.col("n_nationkey").cast("string"), F.lit("]")).alias("placeholder"))
    return lifecycle.whole_cells(cells, known)


@query(
    "WITH v AS (SELECT DISTINCT p_brand AS k, p_type AS value FROM part), e AS (SELECT DISTINCT p_brand AS k, split_part(p_type, ' ', 1) AS entity FROM part WHERE p_size < 10 UNION SELECT DISTINCT p_brand, p_type FROM part WHERE p_size = 10) SELECT k, value, CASE WHEN bool_or(lower(value) = lower(entity)) THEN 'full' ELSE 'partial' END AS hit FROM v JOIN e USING (k) WHERE contains(lower(value), lower(entity)) GROUP BY k, value"
)
def value_hits(spark, sf_dir):
    """Sampled values that are or hold an entity's value."""
    p = read(spark, sf_dir, "part").withColumnRenamed("p_brand", "k")
    values = p.where("p_size < 10").select("k", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("value")).union(p.where("p_size = 10").select("k", F.col("p_type").alias("value")))
    return lifecycle.value_hits(p.select("k", F.col("p_type").alias("value")), values, "k")


@query("SELECT c_custkey AS id, c_mktsegment = 'BUILDING' OR c_nationkey = 3 AS excluded FROM customer")
def excluded_entities(spark, sf_dir):
    """Entities and whole labels taken out."""
    c = read(spark, sf_dir, "customer")
    e = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.lit(None).cast("boolean").alias("excluded"))
    return lifecycle.excluded(e, c.where("c_nationkey = 3").select(F.col("c_custkey").alias("id")), ("BUILDING",)).select("id", "excluded")


@query("WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) SELECT conv_id, turn AS order_no, replace(text, 'a', 'A') AS field FROM b")
def batched_fields(spark, sf_dir):
    """Fields joined, rewritten as one text and split again."""
    c = read(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    batch = lifecycle.fields_text(c, "conv_id", "turn", "text").withColumn("text", F.replace("text", F.lit("a"), F.lit("A")))
    return lifecycle.text_fields(batch, "conv_id", "text")


@query(
    "WITH t AS (SELECT conv_id, turn, '<b x=[EMAIL_9]>[EMAIL_1]</b> `[ORG_' || turn || ']` ' || coalesce(text, '') || ' [IP_2](x[IP_3])' AS text FROM conversations) SELECT conv_id, turn, ['[EMAIL_9]', '[ORG_' || turn || ']', '[IP_3]'] AS left_over FROM t WHERE NOT contains(text, '```') AND (length(text) - length(replace(text, '`', ''))) = 2 AND NOT regexp_matches(text, '\\][(]y')"
)
def protected_placeholders(spark, sf_dir):
    """Placeholders left inside code."""
    c = read(spark, sf_dir, "conversations")
    text = F.concat(F.lit("<b x=[EMAIL_9]>[EMAIL_1]</b> `[ORG_"), F.col("turn").cast("string"), F.lit("]` "), F.coalesce("text", F.lit("")), F.lit(" [IP_2](x[IP_3])"))
    rows = c.select("conv_id", "turn", text.alias("text"))
    return rows.where(~F.contains("text", F.lit("```")) & (F.length(F.regexp_replace("text", "[^`]", "")) == 2)).select("conv_id", "turn", lifecycle.protected_placeholders(F.col("text")).alias("left_over"))


@query("""SELECT p_partkey, 'x "' || replace(replace(p_name || '"\\', '\\', '\\\\'), '"', '\\"') || '" [NO_1]' AS json, '<a>' || replace(replace(replace(p_name || '<&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</a>' AS xml FROM part""")
def restored_syntax(spark, sf_dir):
    """Values escaped for the file they go back into."""
    p = read(spark, sf_dir, "part")
    js = lifecycle.restored(F.lit('x "[NAME_1]" [NO_1]'), F.create_map(F.lit("[NAME_1]"), F.concat("p_name", F.lit('"\\'))), "json")
    xml = lifecycle.restored(F.lit("<a>[NAME_1]</a>"), F.create_map(F.lit("[NAME_1]"), F.concat("p_name", F.lit("<&"))), "xml")
    return p.select("p_partkey", js.alias("json"), xml.alias("xml"))


@query("SELECT c_custkey AS file_id, c_nationkey AS scope, CAST(c_custkey % 4 AS INT) AS written, last FROM customer JOIN (SELECT s_nationkey AS scope, CAST(max(s_suppkey % 4) AS INT) AS last FROM supplier GROUP BY s_nationkey) ON scope = c_nationkey WHERE c_custkey % 4 < last")
def stale_files(spark, sf_dir):
    """Files written before the registry's last version."""
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").alias("scope"), (F.col("c_custkey") % 4).cast("int").alias("written"))
    surfaces = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scope"), (F.col("s_suppkey") % 4).cast("int").alias("version"))
    return lifecycle.stale_files(files, surfaces)


@query("WITH l AS (SELECT DISTINCT l_orderkey AS k, '[' || l_returnflag || '_1]' AS p FROM lineitem WHERE l_returnflag <> 'N') SELECT o_orderkey AS k, count(p) > 0 AS blocked, coalesce(list(p ORDER BY p) FILTER (p IS NOT NULL), []) AS leaked FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY o_orderkey")
def egress_check(spark, sf_dir):
    """Messages kept back and by what."""
    leaks = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("["), "l_returnflag", F.lit("_1]")).alias("placeholder"))
    return lifecycle.egress(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), leaks, "k")


@query("WITH v AS (SELECT DISTINCT p_brand AS v FROM part), k AS (SELECT 'BRAND|' || replace(lower(v), '.', '') AS key, v, row_number() OVER (ORDER BY v) AS r FROM v) SELECT 'all' AS scope, 'BRAND' AS label, key, v AS value, '[BRAND_' || r || ']' AS placeholder, 5 AS version FROM k")
def analysed_registry(spark, sf_dir):
    """New entities of a text's values at the next version."""
    part = read(spark, sf_dir, "part")
    values = part.select(F.lit("all").alias("scope"), F.lit("BRAND").alias("label"), F.col("p_brand").alias("value"), F.col("p_brand").alias("first_seen")).union(spark.createDataFrame([("all", "ORG", "S.r.l.", "z")], "scope string, label string, value string, first_seen string"))
    existing = spark.createDataFrame([], "scope string, label string, key string, placeholder string")
    return lifecycle.analysed(values, existing, 4)[0]


@query()
def checked_entities(spark, sf_dir):
    """K1 to K6: a model's card and phone entities (every run of digits of 7 to 19) against the rules."""
    from ..functions.text import spans

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    runs = docs.where("text IS NOT NULL").select("doc_id", F.explode(spans(F.col("text"), r"[0-9][0-9 \-]{5,20}[0-9]")).alias("s"))
    proposed = runs.select("doc_id", F.explode(F.array(F.lit("CREDITCARDNUMBER"), F.lit("TELEPHONENUM"))).alias("label"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    return postcheck.checked(docs, proposed)
