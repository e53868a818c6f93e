"""Queries over texts: normal forms, facts, overlaps, histograms, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwork.functions import labels, text
from spanwork.operators.components import connected_components
from spanwork.operators.similarity import jaccard_pairs
from spanwork.plans.base import MODEL, RECORDS, records
from spanwork.session import stage_table
from spanwork.sources.tables import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "prompt", "instruction", "split", "input_ifc", "clarification", "target").withColumn("text", F.coalesce("prompt", "instruction")).where("text is not null")


REQUESTS = f"{RECORDS}, q AS (SELECT *, coalesce(prompt, instruction) AS text FROM t WHERE coalesce(prompt, instruction) IS NOT NULL)"


def f1_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by folded name of their texts' first word."""
    first = F.regexp_extract(text.strip_accents(F.col("text")), "([a-z]+)", 1)
    return _documents(spark, sf_dir).groupBy(first.alias("word")).agg(F.count("*").alias("n"))


def f2_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).groupBy(F.md5(text.tidy(F.col("text"))).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def f3_stem_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_record").select("file_id", text.stem_key(F.col("file_name")).alias("stem")).distinct()


def f6_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that share a run of eight words, per run the number of requests."""
    grams = _requests(spark, sf_dir).select("rec_id", F.explode(text.ngrams(text.words(F.col("text")), 8)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 10")


def f7_guids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _requests(spark, sf_dir).select("rec_id", F.explode(text.guids(F.col("text"))).alias("guid"))
    return found.groupBy("guid").agg(F.count("*").alias("n"), F.min("rec_id").alias("first_rec"))


def f8_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.explode(text.numbers(F.col("text"))).alias("number")
    return _requests(spark, sf_dir).select("rec_id", n).groupBy("number").agg(F.count("*").alias("n"), F.count_distinct("rec_id").alias("records"))


def f10_facts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later deliveries of a task id: does the later text keep all figures of the first, and bring no new ones?"""
    rows = _requests(spark, sf_dir).join(table(spark, sf_dir, "task").select("rec_id", "task_id").distinct(), "rec_id").where("task_id is not null")
    facts = rows.select("task_id", "rec_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)))).alias("f"))
    by = Window.partitionBy("task_id").orderBy("rec_id")
    pairs = facts.select("task_id", "rec_id", "f", F.lag("f").over(by).alias("b")).where("b is not null")
    return pairs.select("rec_id", F.size(F.array_except("b", "f")).alias("lost"), F.size(F.array_except("f", "b")).alias("new"))


def f11_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clarifications whose question holds one of its keywords as a whole word."""
    rows = _requests(spark, sf_dir).where("clarification is not null")
    ok = text.asks(F.col("clarification.question"), F.col("clarification.keywords"))
    return rows.groupBy(F.col("clarification.slot").alias("slot"), ok.alias("asks")).agg(F.count("*").alias("n"))


def f12_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a request names its element: by identifier, number, name or description."""
    t = F.col("text")
    kind = F.when(F.size(text.guids(t)) > 0, "identifier").when(t.rlike("(?i)number(ed)? [0-9]{8}"), "number").when(t.rlike(r"'[^':]+:[0-9]{8}'"), "name").otherwise("description")
    return _requests(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def f13_middle_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_item").select("item_id", text.middle_cut(F.col("text"), 80).alias("short"))


def f14_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons with figures left out."""
    return table(spark, sf_dir, "outcome").groupBy(F.regexp_replace("reason", "[0-9]+(?:[.][0-9]+)?", "N").alias("shape")).agg(F.count("*").alias("n"))


def f15_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source models under all their spellings."""
    rows = table(spark, sf_dir, "task").select(labels.model_key(F.col("input_ifc")).alias("model"), "input_ifc")
    return rows.where("model is not null").groupBy("model").agg(F.count_distinct("input_ifc").alias("spellings"), F.count("*").alias("n"))


def f17_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.format_string("%s lies in %s (no. %03d)", F.initcap("n_name"), F.lower("r_name"), "n_nationkey").alias("sentence"))


def f19_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric ratio of two sizes, undefined if one is not positive; exponential score of one less it."""
    a, b = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    r = F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("ratio"))
    return rows.withColumn("reward", F.greatest(F.lit(-0.2), F.least(F.lit(1.0), (F.col("ratio") - 0.25) / 0.75)))


def f22_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compass sector of a direction given by two components."""
    angle = F.pmod(F.degrees(F.atan2(F.col("embedding")[1].cast("double"), F.col("embedding")[0].cast("double"))) + 360, F.lit(360.0))
    return table(spark, sf_dir, "embeddings").groupBy(F.floor(angle / 45).alias("sector")).agg(F.count("*").alias("n"))


def f23_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable keys: a record's task seed from its content."""
    rows = _requests(spark, sf_dir).select("rec_id", F.sha2(F.lower("text"), 256).alias("sha"))
    return rows.select("rec_id", F.substring("sha", 1, 16).alias("key"), F.conv(F.substring("sha", 1, 6), 16, 10).cast("long").alias("seed"))


def f24_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by frequent little words; the most hits win, ties go to the first."""
    lists = {"de": ("die", "der", "und", "nicht", "noch"), "fr": ("la", "le", "les", "dans", "est"), "es": ("el", "los", "las", "por", "se")}
    tokens = text.words(F.col("text"), "[a-z]+")

    def hits(little: tuple[str, ...]):
        return F.size(F.filter(tokens, lambda w: w.isin(*little)))

    score = {k: hits(v) for k, v in lists.items()}
    best = F.greatest(*score.values())
    kind = F.when(best * 8 < F.size(tokens), "en")
    for k, s in score.items():
        kind = kind.when(s == best, k)
    return _documents(spark, sf_dir).groupBy(kind.alias("language")).agg(F.count("*").alias("n"))


def j10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which at least 80 % of all runs of five words are common; copies are represented by the least id."""
    words = text.words(F.col("text"))
    pairs = jaccard_pairs(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id", text.ngram_hashes(words, 5), copy=F.xxhash64(F.array_join(words, " ")))
    return pairs.select("a", "b", F.col("common").cast("long").alias("common"))


def g5_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its group of copies and near-duplicates, and the group's size."""
    plain = F.array_join(text.words(F.col("text")), " ")
    docs = stage_table(spark, _documents(spark, sf_dir).select("doc_id", F.unhex(F.md5(plain)).alias("copy")), "copies")
    reps = docs.groupBy("copy").agg(F.min("doc_id").alias("rep"))
    groups = connected_components(spark, stage_table(spark, j10_near_duplicates(spark, sf_dir).select("a", "b"), "pairs"))
    rows = docs.join(reps, "copy").join(groups.toDF("rep", "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("group_id"))
    rows = stage_table(spark, rows, "groups")
    return rows.join(rows.groupBy("group_id").agg(F.count("*").alias("n")), "group_id")


def j12_shared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share runs of eight words with an evaluation item, with the number of such runs."""
    gram = lambda df, key: df.select(key, F.explode(text.ngrams(text.words(F.col("text")), 8)).alias("gram"))
    items = gram(table(spark, sf_dir, "eval_item"), "item_id")
    return gram(_documents(spark, sf_dir), "doc_id").join(items, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


def a13_canonical_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts posted more than once: how often, and the copy with the oldest date."""
    rows = _documents(spark, sf_dir).groupBy(F.md5("text").alias("copy")).agg(F.count("*").alias("n"), F.min_by("doc_id", F.struct("written_at", "doc_id")).alias("doc_id"))
    return rows.where("n > 1").select("doc_id", "n")


def a20_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in a fixed order, unknown ones last."""
    order = ["sitechat", "mail", "issuethread", "reviewnote", "specsheet"]
    key = labels.squeezed(F.col("source"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), key), F.lit(0)), F.lit(len(order) + 1))
    return table(spark, sf_dir, "documents").groupBy(place.cast("int").alias("place")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("sources"))


def a23_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a JSON column and the types of their values."""
    pairs = table(spark, sf_dir, "task").where("edit_params is not null").select(F.explode(F.from_json("edit_params", "map<string,string>")).alias("name", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(F.col("value").isin("true", "false"), "boolean").when(F.col("value").startswith("["), "list").when(F.col("value").startswith("{"), "object").otherwise("text")
    return pairs.groupBy("name", kind.alias("kind")).agg(F.count("*").alias("n"))


def m1_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose suppliers sell the same mix of part brands: squared cosine of histograms, in exact integers."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    h = l.join(table(spark, sf_dir, "supplier"), "s_suppkey").join(table(spark, sf_dir, "part"), "p_partkey").groupBy("s_nationkey", "p_brand").agg(F.count("*").alias("c"))
    a, b = h.toDF("a", "p_brand", "x"), h.toDF("b", "p_brand", "y")
    dot = a.join(b, "p_brand").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    norm = h.groupBy("s_nationkey").agg(F.sum(F.col("c") * F.col("c")).alias("q"))
    return dot.join(norm.toDF("a", "qa"), "a").join(norm.toDF("b", "qb"), "b").orderBy(F.desc(F.col("dot").cast("double") * F.col("dot") / F.col("qa") / F.col("qb")), "a", "b").limit(20).select("a", "b", "dot", "qa", "qb")


def m2_mean_of_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the axes that are known, in thousandths; 0 without any."""
    axes = F.array_compact(F.array(*[F.floor(F.col(f"score.{a}") * 1000).cast("long") for a in ("geometry", "semantics", "topology")]))
    total = F.aggregate(axes, F.lit(0).cast("long"), lambda s, x: s + x)
    return table(spark, sf_dir, "task_result").groupBy("adapter", F.size(axes).alias("known")).agg(F.sum(F.when(F.size(axes) > 0, F.floor(total / F.size(axes))).otherwise(0)).cast("long").alias("thousandths"), F.count("*").alias("n"))


def m7_map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of two orders of one customer that agree within five percent, as share of all properties."""
    o = table(spark, sf_dir, "orders")
    props = F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("year"), F.year("o_orderdate").cast("double"), F.lit("month"), F.month("o_orderdate").cast("double"))
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.select("o_orderkey", props.alias("p"), F.lag(props).over(by).alias("q")).where("q is not null")
    near = F.map_zip_with("p", "q", lambda k, a, b: F.abs(a - b) <= 0.05 * F.greatest(F.abs(a), F.abs(b)))
    return rows.select("o_orderkey", F.size(F.filter(F.map_values(near), lambda v: v)).alias("agree"), F.size(near).alias("of"))


def m12_budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 4096 samples split in proportion to order value, at least 8 and at most 1024 each, half to even."""
    o = table(spark, sf_dir, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100))
    share = F.bround(F.lit(4096.0) * F.col("cents") / F.sum("cents").over(Window.partitionBy("o_custkey")))
    return o.select("o_orderkey", F.greatest(F.lit(8), F.least(F.lit(1024), share.cast("int"))).alias("samples"))


_W = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_GRAMS = "list_distinct(list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' ')))"
_GUID = "list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_$])([0-3][0-9A-Za-z_$]{21})(?:$|[^0-9A-Za-z_$])', 1), lambda x: x))"
_ORDINALS = "text"
for _i, _w in enumerate(text.ORDINALS, 1):
    _ORDINALS = f"regexp_replace({_ORDINALS}, '\\b{_w}\\b', '{_i}', 'g')"
_COPIES = f"c AS (SELECT array_to_string({_W.format('text')}, ' ') AS plain, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY ALL), w AS (SELECT doc_id, str_split(plain, ' ') AS w FROM c), s AS (SELECT doc_id, unnest({_GRAMS.format('w', 5)}) AS g FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL), j AS (SELECT a, b, common FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 10 * common >= 8 * (na.n + nb.n - common))"

QUERIES = {
    "ref_a13_canonical_copy": a13_canonical_copy, "ref_a20_shares": a20_shares, "ref_a23_profile": a23_profile,
    "ref_f1_fold": f1_fold, "ref_f2_tidy": f2_tidy, "ref_f3_stem_key": f3_stem_key, "ref_f6_ngrams": f6_ngrams, "ref_f7_guids": f7_guids, "ref_f8_numbers": f8_numbers, "ref_f10_facts_kept": f10_facts_kept,
    "ref_f11_asks": f11_asks, "ref_f12_identification": f12_identification, "ref_f13_middle_cut": f13_middle_cut, "ref_f14_shapes": f14_shapes, "ref_f15_paths": f15_paths, "ref_f17_template": f17_template,
    "ref_f19_ratio": f19_ratio, "ref_f22_sector": f22_sector, "ref_f23_keys": f23_keys, "ref_f24_language": f24_language,
    "ref_g5_duplicate_groups": g5_duplicate_groups, "ref_j10_near_duplicates": j10_near_duplicates, "ref_j12_shared_runs": j12_shared_runs,
    "ref_m1_cosine": m1_cosine, "ref_m2_mean_of_known": m2_mean_of_known, "ref_m7_map_match": m7_map_match, "ref_m12_budget_split": m12_budget_split,
}
SQL = {
    "ref_a13_canonical_copy": "SELECT arg_min(doc_id, struct_pack(w := written_at, d := doc_id)) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1",
    "ref_a20_shares": "WITH s AS (SELECT regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS k FROM documents) SELECT CASE k WHEN 'sitechat' THEN 1 WHEN 'mail' THEN 2 WHEN 'issuethread' THEN 3 WHEN 'reviewnote' THEN 4 WHEN 'specsheet' THEN 5 ELSE 6 END AS place, count(*) AS n, count(DISTINCT k) AS sources FROM s GROUP BY ALL",
    "ref_a23_profile": """WITH k AS (SELECT edit_params AS j, unnest(json_keys(edit_params)) AS name FROM task WHERE edit_params IS NOT NULL), v AS (SELECT name, json_type(j, '$."' || name || '"') AS t FROM k)
    SELECT name, CASE WHEN t = 'NULL' THEN 'null' WHEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'ARRAY' THEN 'list' WHEN t = 'OBJECT' THEN 'object' ELSE 'text' END AS kind, count(*) AS n FROM v GROUP BY ALL""",
    "ref_f1_fold": "SELECT regexp_extract(strip_accents(lower(text)), '([a-z]+)', 1) AS word, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "ref_f2_tidy": f"WITH {REQUESTS} SELECT md5(trim(regexp_replace(translate(text, '\u2018\u2019\u201a\u201b`\u00b4\u201c\u201d\u201e\u201f\u00ab\u00bb\u2013\u2014\u00a0\u2009\u202f', '''''''''''''\"\"\"\"\"\"--   '), '\\s+', ' ', 'g'))) AS key, count(*) AS n FROM q GROUP BY ALL HAVING count(*) > 1",
    "ref_f3_stem_key": r"SELECT DISTINCT file_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(file_name)), '^.*[\\/]', ''), '\.[a-z0-9]+$', ''), '^[0-9]+[_-]+', ''), '[_-]*[0-9]{4}[_-]?[0-9]{2}[_-]?[0-9]{2}$', '') AS stem FROM raw_record",
    "ref_f6_ngrams": f"WITH {REQUESTS}, w AS (SELECT rec_id, {_W.format('text')} AS w FROM q), g AS (SELECT rec_id, unnest({_GRAMS.format('w', 8)}) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 10",
    "ref_f7_guids": f"WITH {REQUESTS}, g AS (SELECT rec_id, unnest({_GUID}) AS guid FROM q) SELECT guid, count(*) AS n, min(rec_id) AS first_rec FROM g GROUP BY guid",
    "ref_f8_numbers": f"WITH {REQUESTS}, x AS (SELECT rec_id, {_ORDINALS} AS text FROM q), n AS (SELECT rec_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS number FROM x) SELECT number, count(*) AS n, count(DISTINCT rec_id) AS records FROM n GROUP BY number",
    "ref_f10_facts_kept": f"""WITH {REQUESTS}, f AS (SELECT task_id, rec_id, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')) AS f FROM q WHERE task_id IS NOT NULL), b AS (SELECT rec_id, f, lag(f) OVER (PARTITION BY task_id ORDER BY rec_id) AS b FROM f)
    SELECT rec_id, len(list_filter(b, lambda x: NOT list_contains(f, x)))::INT AS lost, len(list_filter(f, lambda x: NOT list_contains(b, x)))::INT AS new FROM b WHERE b IS NOT NULL""",
    "ref_f11_asks": f"""WITH {REQUESTS} SELECT clarification.slot AS slot, coalesce(contains(clarification.question, '?') AND list_has_any(regexp_split_to_array(lower(clarification.question), '[^a-z]+'), list_transform(clarification.keywords, lambda k: lower(k))), false) AS asks, count(*) AS n FROM q WHERE clarification IS NOT NULL GROUP BY ALL""",
    "ref_f12_identification": f"""WITH {REQUESTS} SELECT CASE WHEN len({_GUID}) > 0 THEN 'identifier' WHEN regexp_matches(text, '(?i)number(ed)? [0-9]{{8}}') THEN 'number' WHEN regexp_matches(text, '''[^'':]+:[0-9]{{8}}''') THEN 'name' ELSE 'description' END AS kind, count(*) AS n FROM q GROUP BY ALL""",
    "ref_f13_middle_cut": "SELECT item_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 38) || '...' || right(text, 39) END AS short FROM eval_item",
    "ref_f14_shapes": "SELECT regexp_replace(reason, '[0-9]+(?:[.][0-9]+)?', 'N', 'g') AS shape, count(*) AS n FROM outcome GROUP BY ALL",
    "ref_f15_paths": f"SELECT {MODEL} AS model, count(DISTINCT input_ifc) AS spellings, count(*) AS n FROM task WHERE {MODEL} IS NOT NULL GROUP BY ALL",
    "ref_f17_template": "SELECT n_nationkey, array_to_string(list_transform(str_split(n_name, ' '), lambda w: upper(left(w, 1)) || lower(w[2:])), ' ') || ' lies in ' || lower(r_name) || ' (no. ' || lpad(n_nationkey::VARCHAR, 3, '0') || ')' AS sentence FROM nation JOIN region ON n_regionkey = r_regionkey",
    "ref_f19_ratio": "WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN least(l_quantity, l_linenumber) / greatest(l_quantity, l_linenumber) END AS ratio FROM lineitem) SELECT *, greatest(-0.2::DOUBLE, least(1.0::DOUBLE, (ratio - 0.25) / 0.75)) AS reward FROM r",
    "ref_f22_sector": "WITH a AS (SELECT degrees(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)) + 360 AS d FROM embeddings) SELECT floor((CASE WHEN d >= 360 THEN d - 360 ELSE d END) / 45)::BIGINT AS sector, count(*) AS n FROM a GROUP BY ALL",
    "ref_f23_keys": f"WITH {REQUESTS}, s AS (SELECT rec_id, sha256(lower(text)) AS s FROM q) SELECT rec_id, s[1:16] AS key, ('0x' || s[1:6])::BIGINT AS seed FROM s",
    "ref_f24_language": """WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT len(w) AS n, len(list_filter(w, lambda x: x IN ('die', 'der', 'und', 'nicht', 'noch'))) AS de, len(list_filter(w, lambda x: x IN ('la', 'le', 'les', 'dans', 'est'))) AS fr, len(list_filter(w, lambda x: x IN ('el', 'los', 'las', 'por', 'se'))) AS es FROM w)
    SELECT CASE WHEN greatest(de, fr, es) * 8 < n THEN 'en' WHEN de = greatest(de, fr, es) THEN 'de' WHEN fr = greatest(de, fr, es) THEN 'fr' WHEN es = greatest(de, fr, es) THEN 'es' END AS language, count(*) AS n FROM s GROUP BY ALL""",
    "ref_g5_duplicate_groups": f"""WITH RECURSIVE {_COPIES}, l AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r AS (SELECT doc_id AS x, doc_id AS y FROM c UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a), m AS (SELECT x, min(y) AS group_id FROM r GROUP BY x),
    d AS (SELECT d.doc_id, m.group_id FROM documents d JOIN c ON c.plain = array_to_string({_W.format('d.text')}, ' ') JOIN m ON m.x = c.doc_id) SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS n FROM d""",
    "ref_j10_near_duplicates": f"WITH {_COPIES} SELECT a, b, common FROM j",
    "ref_j12_shared_runs": f"WITH d AS (SELECT doc_id, {_W.format('text')} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_W.format('text')} AS w FROM eval_item), x AS (SELECT doc_id, unnest({_GRAMS.format('w', 8)}) AS g FROM d), y AS (SELECT item_id, unnest({_GRAMS.format('w', 8)}) AS g FROM e) SELECT doc_id, item_id, count(*) AS n FROM x JOIN y USING (g) GROUP BY ALL",
    "ref_m1_cosine": """WITH h AS (SELECT s_nationkey, p_brand, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), q AS (SELECT s_nationkey, sum(c * c)::BIGINT AS q FROM h GROUP BY ALL),
    d AS (SELECT x.s_nationkey AS a, y.s_nationkey AS b, sum(x.c * y.c)::BIGINT AS dot FROM h x JOIN h y USING (p_brand) WHERE x.s_nationkey < y.s_nationkey GROUP BY ALL) SELECT a, b, dot, qa.q AS qa, qb.q AS qb FROM d JOIN q qa ON qa.s_nationkey = a JOIN q qb ON qb.s_nationkey = b ORDER BY dot::DOUBLE * dot / qa.q / qb.q DESC, a, b LIMIT 20""",
    "ref_m2_mean_of_known": """WITH a AS (SELECT adapter, list_filter([floor(score.geometry * 1000)::BIGINT, floor(score.semantics * 1000)::BIGINT, floor(score.topology * 1000)::BIGINT], lambda x: x IS NOT NULL) AS l FROM task_result)
    SELECT adapter, len(l)::INT AS known, sum(CASE WHEN len(l) > 0 THEN floor(list_sum(l)::DOUBLE / len(l)) ELSE 0 END)::BIGINT AS thousandths, count(*) AS n FROM a GROUP BY ALL""",
    "ref_m7_map_match": """WITH o AS (SELECT o_orderkey, [o_totalprice, year(o_orderdate)::DOUBLE, month(o_orderdate)::DOUBLE] AS p, lag([o_totalprice, year(o_orderdate)::DOUBLE, month(o_orderdate)::DOUBLE]) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders)
    SELECT o_orderkey, len(list_filter([1, 2, 3], lambda i: abs(p[i] - q[i]) <= 0.05::DOUBLE * greatest(abs(p[i]), abs(q[i]))))::INT AS agree, 3::INT AS of FROM o WHERE q IS NOT NULL""",
    "ref_m12_budget_split": "WITH o AS (SELECT o_orderkey, o_custkey, floor(o_totalprice * 100)::BIGINT AS cents FROM orders) SELECT o_orderkey, greatest(8, least(1024, round_even(4096.0::DOUBLE * cents / (sum(cents) OVER (PARTITION BY o_custkey))::DOUBLE, 0)::INT)) AS samples FROM o",
}
