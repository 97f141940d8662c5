"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import errors, text, truncation
from .operators import chats, decisions, entities, fulltext, graph, indexed, lifecycle, namespaces, postings, relational, retrieve, stored_graph, stored_vectors, updates, vector
from .plans import adapters, runtime
from .plans.adapters import KnowledgeBase
from .sources import files as source_files
from .streaming import feeds, timed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[KnowledgeBase], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(KnowledgeBase(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = adapters.SQL + sql
        return fn

    return add


_FILE = "id, path, status, error_msg, file_size, retry_count"
_FACT = "id, subject, predicate, object, confidence, user_score, status"
ENTITY, NODE, OTHER = "Customer#000000001", "NATION_7", "NATION_3"
F_ = lambda df, cols: df.select(*[c.strip() for c in cols.split(",")])


def _of(sql: str, column: str) -> str:
    return sql.replace("@", column)


# The literal rules in DuckDB's words, of a column @.
_DIGITS = "length(regexp_replace(trim(@), '[^0-9]', '', 'g'))"
_BARE = """regexp_replace(trim(@), '[,，\\s''"]', '', 'g')"""
_NUMERIC = (
    f"(trim(@) <> '' AND ((regexp_matches({_BARE}, '^[0-9.+-]+$') AND length({_BARE}) > 1 AND {_DIGITS} >= 0.5 * length({_BARE}))"
    f" OR ({_DIGITS} > 0 AND {_DIGITS} >= 0.3 * length(trim(@)) AND regexp_matches(trim(@), '([元块角分万亿千百天年月日周时钟秒个只条件次项笔张份篇页本节章%％倍成点股手]|[kMGT]?(Hz|B|bps)|[mkc]?m|[kmμ]?g"
    "|(ng|pg)/m[lL]|ng/dl|ng/L|[mμ]mol/L|mmol/l|m?g/L|U/(L|ml)|mIU/L|[×xX]10\\^?[0-9]+/L)$'))"
    f" OR ({_DIGITS} >= 2 AND regexp_matches(trim(@), '^[-+]?\\s*[0-9,，.\\s]+') AND length(regexp_replace(trim(@), '^[-+]?\\s*[0-9,，.\\s]+', '')) <= 6)))"
)
_PHONE = "regexp_matches(trim(@), '^([0-9]{3}-?[0-9]{7,8}|[0-9]{4}-?[0-9]{7,8}|[0-9]{11})$')"
_CODE = (
    f"(regexp_matches(trim(@), '^[0-9]{{17}}[0-9Xx]$') OR (NOT {_PHONE} AND (regexp_matches(trim(@), '^([0-9]{{8,}}|[0-9]{{2,4}}[-/][0-9]{{2,4}}[-/][0-9]{{2,8}}|[0-9]{{6,}}[A-Za-z]{{1,3}}[0-9]*)$')"
    " OR (regexp_matches(trim(@), '^[A-Za-z0-9]{12,}$') AND regexp_matches(@, '[0-9]')))))"
)
_DATE = (
    "regexp_matches(trim(@), '^([0-9]{4}|[0-9]{4}年([0-9]{1,2}月([0-9]{1,2}日?)?)?|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|[0-9]{4}/[0-9]{1,2}(/[0-9]{1,2})?|[0-9]{4}[.][0-9]{1,2}([.][0-9]{1,2})?"
    "|[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|[0-9]+\\s*[天年月日周时分钟秒])$')"
)
_LITERAL = f"(trim(@) = '' OR (NOT {_PHONE} AND ({_NUMERIC} OR {_CODE} OR {_DATE})))"
_CHARS, _COUNT = "list_filter(string_split(@, ''), lambda x: x <> '')", "len(list_filter(list_filter(string_split(@, ''), lambda x: x <> ''), lambda y: y = x))"
_ENTROPY = f"coalesce(list_sum(list_transform(list_distinct({_CHARS}), lambda x: -({_COUNT} / length(@)) * log2({_COUNT} / length(@)))), 0)"
_GRAMS = "list_transform(range(1, length(@)), lambda i: substr(@, i, 2))"
_NGRAM = f"CASE WHEN length(@) < 4 THEN 0 ELSE len(list_filter(list_distinct({_GRAMS}), lambda x: len(list_filter({_GRAMS}, lambda y: y = x)) > 1)) / len(list_distinct({_GRAMS})) END"
_REPEATS = f"coalesce(list_max(list_transform({_CHARS}, lambda x: {_COUNT})), 0) >= 4"
_NAME_CHARS = "len(regexp_extract_all(@, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B81F}\\x{F900}-\\x{FAFF}]'))"
_GIBBERISH = (
    "CASE WHEN trim(@) = '' THEN 1.0 ELSE least(1.0, least(0.4, 0.1 * len(regexp_extract_all(@, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\x{fffd}-\\x{ffff}\\x{200b}-\\x{200f}\\x{feff}]')))"
    f" + CASE WHEN length(@) >= 3 AND {_ENTROPY} < 1.5 THEN 0.3 ELSE 0 END + CASE WHEN {_NGRAM} > 0.5 THEN 0.3 ELSE 0 END + CASE WHEN {_REPEATS} THEN 0.2 ELSE 0 END"
    f" + CASE WHEN {_NAME_CHARS} >= 3 AND len(regexp_extract_all(@, '[A-Za-z]')) BETWEEN 1 AND 2 THEN 0.2 ELSE 0 END) END"
)
_EDGES = f"e AS (SELECT subject AS src, object AS dst, max(id) AS fact_id FROM facts WHERE status = 'active' AND NOT {_of(_LITERAL, 'object')} GROUP BY 1, 2)"
_DEG = "deg AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)"
_NAMES = f"names AS (SELECT subject AS name FROM facts WHERE status = 'active' UNION SELECT object FROM facts WHERE status = 'active' AND NOT {_of(_LITERAL, 'object')})"
_CNT = "cnt AS (SELECT name, count(*) AS n FROM (SELECT subject AS name FROM facts WHERE status = 'active' UNION ALL SELECT object FROM facts WHERE status = 'active') GROUP BY 1)"
_FC = "fc AS (SELECT f.id, f.path, f.indexed_at, f.created_at, coalesce(c.n, 0) AS chunk_count, coalesce(a.n, 0) AS fact_count FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.file_id = f.id LEFT JOIN (SELECT file_id, count(*) AS n FROM facts WHERE status = 'active' GROUP BY 1) a ON a.file_id = f.id WHERE f.status <> 'deleted')"


def _with(*ctes: str) -> str:
    return ", " + ", ".join(ctes) + "\n"


def _placed(df: DataFrame) -> DataFrame:
    """An ordered table with its rows' places, so that a comparison of rows compares the order too.

    The rows stay in their sorted partitions; counts of these, a row each, are summed up to where each begins.
    """
    rows = runtime.materialize(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    begin = counts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(begin, part == F.col("_part")).select((F.col("_at") + F.col("_shift")).alias("place"), *df.columns)


# Sources
query("src_02_exclude", "SELECT id FROM files WHERE NOT list_contains(string_split(path, '/'), 'src0')")(lambda k: k.files.filter(~source_files.excluded(F.col("path"), ("src0",))).select("id"))
query("src_03_hash", "SELECT doc_id, sha256 FROM hashed")(lambda k: k.hashed.select("doc_id", "sha256"))
query("src_04_known_hashes", "SELECT path, sha256 FROM files WHERE status <> 'deleted'")(lambda k: source_files.known_hashes(k.files))
query("src_05_supported", "SELECT id, regexp_extract(path, '[.][A-Za-z]+$') <> '.xyz' AS ok FROM files")(lambda k: k.files.select("id", source_files.supported(F.col("path")).alias("ok")))
query(
    "src_06_route",
    "SELECT id, CASE WHEN file_size > 52428800 THEN 'too_large' ELSE CASE lower(regexp_extract(path, '[.][A-Za-z]+$')) WHEN '.md' THEN 'text' WHEN '.txt' THEN 'text' WHEN '.py' THEN 'python' WHEN '.csv' THEN 'csv' WHEN '.html' THEN 'html' WHEN '.png' THEN 'external' WHEN '.pdf' THEN 'external' ELSE 'unsupported' END END AS route FROM files",
)(lambda k: k.files.select("id", source_files.route(F.col("path"), F.col("file_size")).alias("route")))
query(
    "src_09_html_text",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""",
)(lambda k: k.table("pages").select("page_id", source_files.html_text(F.col("html")).alias("body")))
query("src_11_needs_ocr", r"SELECT doc_id, length(trim(regexp_replace(text, '[^\pL\pN\s]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) < 200 OR (doc_id % 2 = 0 AND doc_id * 1000 > 1048576 AND length(trim(regexp_replace(text, '[^\pL\pN\s]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) / (doc_id * 1000 / 1024.0) < 10) AS ocr FROM documents")(
    lambda k: k.table("documents").select("doc_id", source_files.needs_ocr(F.col("text"), F.col("doc_id") * 1000, F.when(F.col("doc_id") % 2 == 0, "a.pdf").otherwise("a.md")).alias("ocr"))
)


def _nations(k: KnowledgeBase, made: str) -> DataFrame:
    """Small source texts made of the nations' names: (key, t)."""
    return k.table("nation").select(F.col("n_nationkey").alias("key"), F.expr(made).alias("t"))


def _read(how) -> Callable:
    return F.udf(how, "string")


_NL = "chr(10)"
query(
    "src_14_python",
    "SELECT n_nationkey AS key, concat('import os', chr(10), chr(10), 'class ', n_name, '(Base):', chr(10), '    def go(self, x: int) -> str: ...', chr(10), '@cached', chr(10), 'def f(a, b):', chr(10), '    \"\"\"Adds.\"\"\"', chr(10), 'def go(self, x: int) -> str: ...') AS t FROM nation",
)(
    lambda k: _nations(k, "concat('import os\\n\\nclass ', n_name, '(Base):\\n    def go(self, x: int) -> str:\\n        return x\\n\\n@cached\\ndef f(a, b):\\n    \"Adds.\"\\n    return a + b\\n')").select(
        "key", _read(source_files.python_outline)("t").alias("t")
    )
)
query("src_15_code", "SELECT n_nationkey AS key, concat('package main', chr(10), '  // says ', n_name, chr(10), 'func main() {') AS t FROM nation")(
    lambda k: _nations(k, "concat('package main\\n\\n  // says ', n_name, '\\nfunc main() {\\n  use(1)\\n  x := \"', n_name, '\"\\n}\\n')").select("key", source_files.code_outline(F.col("t")).alias("t"))
)
query("src_16_csv", "SELECT n_nationkey AS key, concat('CSV file: n.csv', chr(10), 'Columns (2): key, name', chr(10), 'Rows: 12', chr(10), chr(10), 'Sample (first 10 rows):', repeat(concat(chr(10), '  ', n_nationkey, ' | ', n_name, ', the'), 10)) AS t FROM nation")(
    lambda k: _nations(k, "concat('key,name', repeat(concat('\\n', n_nationkey, ',\"', n_name, ', the\"'), 12), '\\n')").select("key", _read(lambda t: source_files.csv_summary(t, "n.csv"))("t").alias("t"))
)
query("src_17_json", "SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN concat('{', chr(10), '  \"k\": [', chr(10), '    ', n_nationkey, chr(10), '  ]', chr(10), '}') ELSE concat('{\"k\": ', n_name) END AS t FROM nation")(
    lambda k: _nations(k, "CASE WHEN n_nationkey % 2 = 0 THEN concat('{\"k\": [', n_nationkey, ']}') ELSE concat('{\"k\": ', n_name) END").select("key", _read(source_files.json_text)("t").alias("t"))
)


def _purged(k: KnowledgeBase) -> DataFrame:
    kept, gone = source_files.purge({"facts": k.facts, "files": k.files, "chat_history": k.chat})
    left = {n: d.count() for n, d in kept.items()}
    return k.spark.createDataFrame([(n, gone.get(n, 0), left[n]) for n in left], "name string, gone long, left long")


query("snk_06_purge", "SELECT 'facts' AS name, count(*) AS gone, 0 AS left FROM facts UNION ALL SELECT 'files', count(*), 0 FROM files UNION ALL SELECT 'chat_history', 0, count(*) FROM chat")(_purged)


def _appended(k: KnowledgeBase) -> DataFrame:
    path = f"{runtime.shared_dir(k.spark)}/appended-{uuid.uuid4().hex}"
    source_files.append(k.facts.filter("id % 2 = 0").select("id", "predicate"), path, "predicate")
    source_files.append(k.facts.filter("id % 2 = 1").select("id", "predicate"), path, "predicate")
    return k.spark.read.schema("id long, predicate string").parquet(path)


query("snk_01_append", "SELECT id, predicate FROM facts")(_appended)
query("src_12_longer", "SELECT doc_id, CASE WHEN length(source) > length(lang) THEN source ELSE lang END AS t FROM documents")(lambda k: k.table("documents").select("doc_id", source_files.with_ocr(F.col("lang"), F.col("source")).alias("t")))
query("snk_02_upsert", "SELECT count(*) AS n, count(*) FILTER (WHERE sha256 = 'old') AS old FROM (SELECT coalesce(p.sha256, f.sha256) AS sha256 FROM files f FULL JOIN previous p ON f.path = p.path)")(
    lambda k: updates.upsert(k.files, k.previous.select("path", "sha256")).agg(F.count("*").alias("n"), F.count_if(F.col("sha256") == "old").alias("old"))
)
query("snk_08_log_tail")(lambda k: source_files.log_lines(k.table("events").select(F.concat_ws(" ", F.lit("2024"), F.upper("event_type"), F.lit("x")).alias("value")), "ERROR"))

# Filters
query("flt_01_files_by_status", f"SELECT {_FILE} FROM files WHERE status = 'failed'")(lambda k: F_(relational.by_value(k.files, "status", "failed"), _FILE))
query("flt_02_file_by_id", f"SELECT {_FILE} FROM files WHERE id = 42")(lambda k: F_(relational.by_value(k.files, "id", 42), _FILE))
query("flt_04_facts_of_file", f"SELECT {_FACT} FROM facts WHERE file_id = 17 AND status = 'active'")(lambda k: F_(relational.by_value(k.facts.filter("status = 'active'"), "file_id", 17), _FACT))
query("flt_05_facts_of_entity", f"SELECT {_FACT} FROM facts WHERE status = 'active' AND (subject = '{ENTITY}' OR object = '{ENTITY}') ORDER BY id LIMIT 50")(lambda k: F_(relational.facts_of_entity(k.facts, ENTITY), _FACT))
query("flt_06_without_embedding", "SELECT id FROM facts WHERE status = 'active' AND id NOT IN (SELECT vec_id FROM embeddings) ORDER BY id LIMIT 200 OFFSET 100")(
    lambda k: relational.page(k.facts.filter("status = 'active'").join(k.embeddings.select(F.col("fact_id").alias("id")), "id", "left_anti").select("id"), ["id"], 200, 100)
)
query("flt_07_embedded_ids", "SELECT id FROM facts WHERE status = 'active' AND id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)")(
    lambda k: k.facts.filter("status = 'active'").join(k.embeddings.filter("embedding IS NOT NULL").select(F.col("fact_id").alias("id")), "id", "left_semi").select("id")
)
query("flt_08_user_scores", "SELECT id, user_score FROM facts WHERE id IN (SELECT vec_id FROM embeddings)")(lambda k: relational.pick(k.facts, k.embeddings.select(F.col("fact_id").alias("id")), "id").select("id", "user_score"))
query("flt_09_chunks_of_file", "SELECT id, chunk_index, content FROM chunks WHERE file_id = 42")(lambda k: relational.by_value(k.chunks, "file_id", 42).select("id", "chunk_index", "content"))
query("flt_10_due", "SELECT id, error_class FROM failed_chunks WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= 500) ORDER BY created_at, id LIMIT 10")(lambda k: relational.due(k.failed_chunks, 500).select("id", "error_class"))
query("flt_11_proposals", "SELECT row_number() OVER (ORDER BY confidence DESC, id) AS place, id, entity_a, confidence FROM proposals WHERE status = 'proposed' AND proposal_type = 'merge'")(
    lambda k: _placed(relational.proposals_by(k.proposals, kind="merge")).select("place", "id", "entity_a", "confidence")
)
query("flt_12_all_proposals", "SELECT row_number() OVER (ORDER BY created_at DESC, id DESC) AS place, id, status, proposal_type FROM proposals")(lambda k: _placed(relational.all_proposals(k.proposals)).select("place", "id", "status", "proposal_type"))
query("flt_03_directories", "SELECT row_number() OVER (ORDER BY path) AS place, path FROM (SELECT DISTINCT concat('/kb/', source) AS path FROM documents)")(
    lambda k: _placed(relational.directories(k.table("documents").select(F.concat(F.lit("/kb/"), "source").alias("path")).distinct()))
)
query("flt_13_transcript", "SELECT row_number() OVER (ORDER BY created_at, id) AS place, id, role, content FROM chat WHERE kb_name = 'main' AND session_id = '2'")(lambda k: _placed(relational.transcript(k.chat, "main", "2")).select("place", "id", "role", "content"))
query("flt_14_json_columns", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")(lambda k: k.table("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k")))
query("flt_15_last_run", "SELECT id, status, stop_requested FROM runs ORDER BY id DESC LIMIT 1")(lambda k: k.runs.orderBy(F.desc("id")).limit(1).select("id", "status", "stop_requested"))
query("flt_16_search_files", "SELECT id, path FROM files WHERE status <> 'deleted' AND path ILIKE '%SRC1_/%'")(lambda k: relational.file_filter(k.files, search="SRC1_/").select("id", "path"))
query("flt_17_ocr_files", "SELECT id FROM files WHERE error_msg ILIKE '%OCR%'")(lambda k: k.files.filter(F.col("error_msg").ilike("%OCR%")).select("id"))
query("flt_18_vanished", "SELECT id FROM files WHERE status <> 'deleted' AND path NOT IN (SELECT path FROM previous)")(lambda k: relational.vanished(k.files, k.previous).select("id"))
query("flt_19_search_nodes", _with(_EDGES, _DEG) + "SELECT name, degree FROM deg WHERE contains(lower(name), 'on_1') ORDER BY degree DESC, name LIMIT 20")(lambda k: graph.search_nodes(graph.build_edges(k.facts), "ON_1"))
query("flt_20_fact_rows", f"SELECT {_FACT} FROM facts WHERE predicate = 'in_nation'")(lambda k: F_(k.facts.filter("predicate = 'in_nation'"), _FACT))
query("flt_21_names", "SELECT DISTINCT kb_name FROM chat WHERE contains(lower(kb_name), 'ma')")(lambda k: k.chat.select("kb_name").distinct().filter(F.lower("kb_name").contains("ma")))
query("flt_22_sizes", "SELECT id, CASE WHEN file_size < 1024 THEN printf('%d B', file_size) WHEN file_size < 1048576 THEN printf('%.1f KB', floor(file_size * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(file_size * 10 / 1048576.0 + 0.5) / 10) END AS size FROM files")(
    lambda k: k.files.select("id", text.human_size(F.col("file_size")).alias("size"))
)

# Updates
query("upd_01_mark_dead", "SELECT id, CASE WHEN status = 'failed' AND retry_count >= 3 THEN 'dead' ELSE status END AS status FROM files")(lambda k: updates.set_where(k.files, (F.col("status") == "failed") & (F.col("retry_count") >= 3), status="dead").select("id", "status"))
query("upd_02_retry_count", "SELECT id, cast(CASE WHEN status = 'failed' THEN retry_count + 1 ELSE retry_count END AS INT) AS retry_count FROM files")(lambda k: updates.retry_count(k.files, F.col("status") == "failed").select("id", "retry_count"))
query("upd_03_soft_delete", "SELECT id, CASE WHEN file_id IN (SELECT id FROM files WHERE status = 'failed') THEN 'deleted' ELSE status END AS status, CASE WHEN file_id NOT IN (SELECT id FROM files WHERE status = 'failed') THEN chunk_id END AS chunk_id FROM facts")(
    lambda k: updates.soft_delete(k.files, k.facts, F.col("status") == "failed")[1].select("id", "status", "chunk_id")
)
query("upd_04_delete_chunks", "SELECT id FROM chunks WHERE file_id NOT IN (SELECT id FROM files WHERE status = 'failed')")(
    lambda k: updates.delete_chunks(k.chunks, k.failed_chunks, k.files.filter("status = 'failed'").select(F.col("id").alias("file_id")))[0].select("id")
)
query("upd_05_clamp", "SELECT id, least(2.0, greatest(0.0, user_score + 0.5))::DOUBLE AS user_score FROM facts")(lambda k: k.facts.select("id", updates.clamp(F.col("user_score"), 0.5).alias("user_score")))
query("upd_06_decay", "SELECT id, CASE WHEN status = 'active' THEN user_score - (user_score - 1.0::DOUBLE) * 0.01::DOUBLE ELSE user_score END AS user_score FROM facts")(lambda k: updates.decay(k.facts).select("id", "user_score"))
query("upd_07_rename", f"SELECT id, CASE WHEN status = 'active' AND subject = '{NODE}' THEN 'Gaul' ELSE subject END AS subject, CASE WHEN status = 'active' AND object = '{NODE}' THEN 'Gaul' ELSE object END AS object FROM facts")(
    lambda k: updates.rename_entity(k.facts, NODE, "Gaul").select("id", "subject", "object")
)
query("upd_08_delete_entity", f"SELECT id, CASE WHEN status = 'active' AND (subject = '{NODE}' OR object = '{NODE}') THEN 'deleted' ELSE status END AS status FROM facts")(lambda k: updates.delete_entity(k.facts, NODE).select("id", "status"))
query("upd_09_batch", f"SELECT id, CASE WHEN status = 'active' AND ('{NODE}' IN (subject, object) OR '{OTHER}' IN (subject, object)) THEN 'deleted' ELSE status END AS status FROM facts")(
    lambda k: updates.batch_entities(k.facts, [{"op": "rename", "name": NODE, "new_name": OTHER}, {"op": "x"}, {"op": "delete", "name": OTHER}])[0].select("id", "status")
)
query("upd_09_results", "SELECT * FROM (VALUES ('rename', true, NULL), ('x', false, 'unknown operation'), ('delete', true, NULL), ('rename', false, 'new name is missing')) t(op, ok, error)")(
    lambda k: k.spark.createDataFrame(
        [(r["op"], r["ok"], r["error"]) for r in updates.batch_entities(k.facts, [{"op": "rename", "name": NODE, "new_name": OTHER}, {"op": "x"}, {"op": "delete", "name": OTHER}, {"op": "rename", "name": "a"}])[1]], "op string, ok boolean, error string"
    )
)
query("upd_10_review", "SELECT id, CASE WHEN id = 7 THEN 'approved' ELSE status END AS status FROM proposals")(lambda k: updates.set_where(k.proposals, F.col("id") == 7, status="approved").select("id", "status"))
query("upd_11_requeue", "SELECT id, CASE WHEN id % 100 = 0 AND status <> 'done' THEN 'pending' ELSE status END AS status FROM failed_chunks")(lambda k: updates.set_where(k.failed_chunks, (F.col("id") % 100 == 0) & (F.col("status") != "done"), status="pending").select("id", "status"))
query("upd_12_prune", "SELECT id FROM failed_chunks WHERE created_at >= 300")(lambda k: updates.prune(k.failed_chunks, 300).select("id"))
query("upd_13_finish_run", "SELECT id, CASE WHEN id = 5 THEN 'completed' ELSE status END AS status FROM runs")(lambda k: updates.set_where(k.runs, F.col("id") == 5, status="completed").select("id", "status"))
query("upd_14_repair", "SELECT id, CASE status WHEN 'processing' THEN 'pending' ELSE status END AS status FROM files")(lambda k: lifecycle.repair(k.runs, k.files)[1].select("id", "status"))
query("upd_15_write_back", "SELECT f.id, v.embedding IS NOT NULL AS has FROM facts f LEFT JOIN embeddings v ON f.id = v.vec_id")(lambda k: updates.write_back(k.facts, k.embeddings).select("id", F.col("embedding").isNotNull().alias("has")))
query("upd_16_delete_directory", "SELECT id FROM facts WHERE file_id NOT IN (SELECT id FROM files WHERE directory_id = 3)")(lambda k: updates.delete_directory(k.files, k.chunks, k.facts, 3)[2].select("id"))
query("upd_17_checkpoint", "SELECT id, CASE WHEN id = 6 THEN 'done' ELSE status END AS status FROM files")(lambda k: updates.checkpoint(k.files, k.chunks, 6)[0].select("id", "status"))
query("upd_18_chunk_status", "SELECT id, CASE WHEN file_id = 3 THEN 'pending' ELSE status END AS status FROM chunks")(lambda k: updates.set_where(k.chunks, F.col("file_id") == 3, status="pending").select("id", "status"))

# Joins, aggregates, windows, pages, sets
query("join_01_list_files", _with(_FC) + "SELECT id, path, chunk_count, fact_count FROM fc ORDER BY indexed_at DESC NULLS LAST, created_at DESC, id LIMIT 50 OFFSET 10")(lambda k: relational.list_files(k.files, k.chunks, k.facts, offset=10).select("id", "path", "chunk_count", "fact_count"))
query("agg_03_zero_facts", _with(_FC) + "SELECT id FROM fc WHERE fact_count = 0 ORDER BY indexed_at DESC NULLS LAST, created_at DESC, id LIMIT 50")(lambda k: relational.list_files(k.files, k.chunks, k.facts, zero_facts=True).select("id"))
query("agg_02_counts_by_file", _with(_FC) + "SELECT id, chunk_count, fact_count FROM fc")(lambda k: relational.list_files(k.files, k.chunks, k.facts, limit=None).select("id", "chunk_count", "fact_count"))
query("join_02_count_files", _with(_FC) + "SELECT count(*) AS n FROM fc WHERE fact_count = 0")(lambda k: relational.count_files(k.files, k.facts, True))
query("join_04_hydrate", "SELECT v.vec_id AS fact_id, f.subject, f.object, p.path FROM embeddings v JOIN facts f ON f.id = v.vec_id AND f.status = 'active' LEFT JOIN files p ON p.id = f.file_id")(
    lambda k: relational.hydrate(k.embeddings.select("fact_id"), k.facts, k.files).select("fact_id", "subject", "object", "path")
)
query("join_05_entity_sources", "SELECT entity, string_agg(path, ' ' ORDER BY path) AS sources FROM (SELECT DISTINCT entity, path FROM (SELECT subject AS entity, file_id FROM facts WHERE status = 'active' UNION ALL SELECT object, file_id FROM facts WHERE status = 'active') x JOIN files ON files.id = x.file_id) GROUP BY 1")(
    lambda k: relational.entity_sources(k.facts, k.files).select("entity", F.array_join("sources", " ").alias("sources"))
)
query("join_15_verdicts", "SELECT id AS ordinal, id % 3 = 0 AS same FROM proposals")(
    lambda k: relational.verdicts(k.proposals.select(F.col("id").alias("ordinal")), k.proposals.filter("id % 2 = 0 OR id % 3 = 0").select(F.col("id").alias("ordinal"), (F.col("id") % 3 == 0).alias("same")))
)
query("join_06_failed_paths", "SELECT c.id, error_class, path FROM failed_chunks c LEFT JOIN files ON files.id = c.file_id ORDER BY c.created_at DESC, c.id DESC LIMIT 100")(lambda k: relational.with_path(k.failed_chunks, k.files).select("id", "error_class", "path"))
query("join_07_suspects", _with(_NAMES) + "SELECT name FROM names WHERE name IN (SELECT entity_a FROM proposals WHERE status = 'proposed' AND proposal_type = 'suspect')")(lambda k: relational.valid_entities(k.facts).join(relational.proposal_names(k.proposals, "suspect"), "name", "left_semi"))
query("join_08_merges", _with(_NAMES) + "SELECT DISTINCT name FROM names JOIN (SELECT * FROM proposals WHERE status = 'proposed' AND proposal_type = 'merge') p ON name = entity_a OR name = entity_b")(
    lambda k: relational.valid_entities(k.facts).join(relational.proposal_names(k.proposals, "merge"), "name", "left_semi")
)
query("join_09_snapshot_diff", "SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN c.sha256 <> p.sha256 THEN 'modified' ELSE 'unchanged' END AS change FROM files c FULL JOIN previous p ON c.path = p.path")(
    lambda k: relational.snapshot_diff(k.files, k.previous)
)
query("join_10_not_proposed", _with(_NAMES) + "SELECT name FROM names WHERE name NOT IN (SELECT entity_a FROM proposals WHERE proposal_type = 'suspect')")(lambda k: relational.not_proposed(relational.valid_entities(k.facts), k.proposals))
query("join_12_similar_pairs", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.35")(
    lambda k: vector.similar_pairs(k.embeddings, 0.35, "label").select("a", "b")
)
query("join_14_under_directory", "SELECT id FROM files WHERE starts_with(path, '/kb/src1/') OR starts_with(path, '/kb/src2/')")(lambda k: relational.under_directories(k.files, ["/kb/src1", "/kb/src2/"]).select("id"))
query("agg_01_counts", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM facts WHERE status = 'active') AS facts, (SELECT count(*) FROM chunks WHERE status = 'done') AS chunks_done")(lambda k: relational.counts(k.files, k.facts, k.chunks))
query("agg_04_entity_counts", _with(_CNT) + "SELECT name, n FROM cnt")(lambda k: relational.entity_counts(k.facts))
query("agg_05_sessions", "SELECT session_id, min(created_at) AS started, count(*) FILTER (WHERE role = 'user') AS questions, max(created_at) AS latest FROM chat WHERE kb_name = 'main' GROUP BY 1")(lambda k: relational.chat_sessions(k.chat, "main"))
query("agg_06_failed_by_class", "SELECT error_class, count(*) AS n FROM failed_chunks WHERE status = 'pending' GROUP BY 1")(lambda k: relational.failed_by_class(k.failed_chunks))
query("agg_07_failure_report", "SELECT count(*) AS total_failed, count(*) FILTER (WHERE error_class IN ('RATE_LIMIT', 'TIMEOUT', 'MODEL_UNAVAILABLE')) AS can_retry FROM failed_chunks WHERE status = 'pending'")(lambda k: relational.failure_report(k.failed_chunks).select("total_failed", "can_retry"))
query("agg_08_dashboard", "SELECT count(*) AS total_failed, count(*) FILTER (WHERE error_class <> 'UNKNOWN') AS can_retry FROM failed_chunks WHERE status = 'pending'")(lambda k: relational.failure_report(k.failed_chunks, True).select("total_failed", "can_retry"))
_SRC = "src AS (SELECT name, count(*) AS sources, count(*) FILTER (WHERE ocr) AS ocr, count(*) FILTER (WHERE image) AS images FROM (SELECT DISTINCT name, f.id, f.error_msg ILIKE '%OCR%' AS ocr, ends_with(f.path, '.png') AS image FROM (SELECT subject AS name, file_id FROM facts WHERE status = 'active' UNION ALL SELECT object, file_id FROM facts WHERE status = 'active') x JOIN files f ON f.id = x.file_id) GROUP BY 1)"
_CHECKED = (
    f"scored AS (SELECT n.name, coalesce(degree, 0) AS degree, coalesce(sources, 0) AS sources, coalesce(ocr, 0) AS ocr, coalesce(images, 0) AS images, {_of(_GIBBERISH, 'n.name')} AS g FROM names n LEFT JOIN deg USING (name) LEFT JOIN src USING (name)), "
    "flagged AS (SELECT name, g, list_filter([CASE WHEN length(name) <= 1 THEN 'too_short' WHEN length(name) > 15 THEN 'too_long' END, CASE WHEN round(g, 9) >= 0.3 THEN 'gibberish' END, CASE WHEN degree = 0 THEN 'isolated' END, "
    f"CASE WHEN ocr > 0 AND ocr = sources THEN 'ocr_only' END, CASE WHEN sources > 0 AND images = sources THEN 'image_source' END, CASE WHEN {_of(_NUMERIC, 'name')} THEN 'numeric_dominant' END, CASE WHEN {_of(_CODE, 'name')} THEN 'looks_like_code' END, "
    f"CASE WHEN {_of(_DATE, 'name')} THEN 'looks_like_date' END], lambda x: x IS NOT NULL) AS flags FROM scored)"
)
_QA = _with(_EDGES, _DEG, _NAMES, _SRC, _CHECKED)
query("agg_09_flag_stats", _QA + "SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM flagged) GROUP BY 1")(lambda k: entities.flag_stats(entities.check(entities.entity_table(k.facts, k.files))))
query("agg_11_degrees", _with(_EDGES, _DEG) + "SELECT name, degree FROM deg")(lambda k: graph.degrees(graph.build_edges(k.facts)))
query("agg_12_properties", f"SELECT subject AS name, predicate, string_agg(object, ' ' ORDER BY id) AS t FROM facts WHERE status = 'active' AND {_of(_LITERAL, 'object')} GROUP BY 1, 2")(
    lambda k: graph.build_properties(k.facts).select("name", F.explode("properties").alias("predicate", "v")).select("name", "predicate", F.array_join("v", " ").alias("t"))
)
query("agg_16_status", _with(_EDGES) + "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM facts WHERE status = 'active') AS facts, (SELECT count(*) FROM chunks WHERE status = 'done') AS chunks_done, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM embeddings) AS vectors, (SELECT status FROM runs ORDER BY id DESC LIMIT 1) AS last_run")(
    lambda k: relational.status(k.files, k.facts, k.chunks, graph.build_edges(k.facts), k.embeddings, k.runs)
)
query("agg_14_topics", r"SELECT topic, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')[1:10]) AS topic FROM chat WHERE role = 'user') GROUP BY 1 ORDER BY n DESC, topic LIMIT 10")(lambda k: relational.topics(k.chat.filter("role = 'user'")))
query("agg_15_best_triples", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY confidence DESC, id) AS r FROM facts) WHERE r = 1")(lambda k: relational.best_triples(k.facts).select("id"))
query("agg_17_run_reasons", "SELECT status, count(*) AS n FROM runs GROUP BY 1")(lambda k: relational.count_by(k.runs, "status"))
query("agg_20_directories", "SELECT directory_id, count(*) AS n FROM files GROUP BY 1")(lambda k: relational.count_by(k.files, "directory_id"))
query("agg_21_merge_counters", "SELECT count(*) FILTER (WHERE status = 'approved') AS same, count(*) FILTER (WHERE status = 'rejected') AS not_same, count(*) AS total FROM proposals")(lambda k: relational.merge_counters(k.proposals))
query("win_01_ranks", "SELECT id, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, id) - 1 AS rank FROM facts")(lambda k: relational.ranks(k.facts, "file_id", [F.desc("confidence"), F.col("id")]).select("id", F.col("rank").cast("long")))
query("win_02_overlap", "SELECT id, CASE WHEN length(lag(content) OVER w) > 20 THEN right(lag(content) OVER w, 20) || chr(10) || chr(10) || content ELSE content END AS content FROM chunks WINDOW w AS (PARTITION BY file_id ORDER BY chunk_index)")(lambda k: relational.with_overlap(k.chunks, 20).select("id", "content"))


def _graph(k: KnowledgeBase) -> stored_graph.StoredGraph:
    """The stored graph of the facts: built when first asked for, and again when their tables change."""
    made = stored_graph.StoredGraph(k.spark, k.stored("graph"))
    return made if made.files.segments() else stored_graph.build(k.facts, made.files.path)


def _graph_kept_up(k: KnowledgeBase) -> DataFrame:
    """A graph of two thirds of the facts that gets the rest, loses a fifth of all, is merged and loses another seventh."""
    made = stored_graph.StoredGraph(k.spark, k.stored("graph-kept-up"))
    if not made.files.segments():
        made.change(put=k.facts.filter("id % 3 <> 0"))
        made.change(put=k.facts.filter("id % 3 = 0"), taken=k.facts.filter("id % 3 <> 0 AND id % 5 = 1"))
        made.merge()
        made.change(taken=k.facts.filter("id % 7 = 2"))
    return made.edges()


query("gr_02_kept_up", _with("now AS (SELECT * FROM facts WHERE NOT (id % 3 <> 0 AND id % 5 = 1) AND id % 7 <> 2)", _EDGES.replace("FROM facts", "FROM now")) + "SELECT src, dst, fact_id FROM e")(lambda k: _graph_kept_up(k).select("src", "dst", "fact_id"))
query("win_03_last_edge", _with(_EDGES) + "SELECT src, dst, fact_id FROM e")(lambda k: _graph(k).edges().select("src", "dst", "fact_id"))
query("win_06_chunk_ordinal", "SELECT id, chunk_index FROM chunks")(lambda k: relational.ranks(k.chunks.select("id", "file_id"), "file_id", [F.col("id")]).select("id", F.col("rank").alias("chunk_index")))
query("topk_05_entities", _with(_NAMES, _CNT) + "SELECT name, n FROM names JOIN cnt USING (name) ORDER BY n DESC, name LIMIT 50 OFFSET 50")(lambda k: relational.list_entities(k.facts, k.proposals, page_no=2).select("name", "n"))
query("qa_05_list_entities", _with(_NAMES, _CNT) + "SELECT name, n, name IN (SELECT entity_a FROM proposals WHERE status = 'proposed' AND proposal_type = 'suspect') AS has_suspect, name IN (SELECT unnest([entity_a, entity_b]) FROM proposals WHERE status = 'proposed' AND proposal_type = 'merge') AS has_merge FROM names JOIN cnt USING (name) WHERE contains(lower(name), 'supplier') ORDER BY name LIMIT 50")(
    lambda k: relational.list_entities(k.facts, k.proposals, search="Supplier", sort_by="name", descending=False)
)
query("set_03_valid_entities", _with(_NAMES) + "SELECT name FROM names")(lambda k: relational.valid_entities(k.facts))
query("set_04_work_list", "SELECT path FROM files WHERE status = 'pending' UNION SELECT path FROM previous WHERE sha256 = 'old'")(lambda k: relational.work_list(k.files.filter("status = 'pending'"), k.previous.filter("sha256 = 'old'")))
query("set_05_boost", "SELECT id, least(2.0::DOUBLE, 1.0::DOUBLE + 0.05::DOUBLE * len(list_intersect(string_split(lower(subject || ' ' || predicate || ' ' || object), ' '), ['asia', 'in_region', 'nation_7']))) AS boost FROM facts")(
    lambda k: retrieve.boost(k.facts, ["ASIA", "in_region", "Nation_7"]).select("id", "boost")
)

# Graph
query("gr_04_neighbours", _with(_EDGES) + f"SELECT dst AS name, 'out' AS direction FROM e WHERE src = '{NODE}' UNION ALL SELECT src, 'in' FROM e WHERE dst = '{NODE}'")(lambda k: graph.neighbours(graph.build_edges(k.facts), NODE).select("name", "direction"))
query("gr_05_merge_nodes", _with(_EDGES) + f"SELECT DISTINCT CASE WHEN src = '{NODE}' THEN '{OTHER}' ELSE src END AS src, CASE WHEN dst = '{NODE}' THEN '{OTHER}' ELSE dst END AS dst FROM e WHERE NOT (src IN ('{NODE}', '{OTHER}') AND dst IN ('{NODE}', '{OTHER}'))")(
    lambda k: graph.merge_nodes(graph.build_edges(k.facts), NODE, OTHER).select("src", "dst")
)
query("gr_06_nodes", _with(_NAMES) + "SELECT name FROM names")(lambda k: graph.nodes(k.facts))
query("gr_02_all_edges", f"SELECT subject AS src, object AS dst, predicate, id AS fact_id FROM facts WHERE status = 'active' AND NOT {_of(_LITERAL, 'object')}")(lambda k: graph.build_edges(k.facts, multi=True).select("src", "dst", "predicate", "fact_id"))
query("gr_05_rewired", _with(_EDGES) + f"SELECT count(*) AS n FROM e WHERE '{NODE}' IN (src, dst)")(lambda k: graph.rewired(graph.build_edges(k.facts), NODE))
query("gr_08_dot", _with(_EDGES) + """SELECT '  "' || src || '" -> "' || dst || '" [label="' || predicate || '"];' AS line FROM e JOIN facts ON facts.id = fact_id""")(lambda k: graph.dot(graph.build_edges(k.facts)))
for _h in (1, 2, 3):
    _step = _with(_EDGES, "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)", "l0 AS (SELECT 'ASIA' AS name, 0 AS depth)") + ""
    _lv = ""
    for _i in range(1, _h + 1):
        _prev = f"s{_i - 1}" if _i > 1 else "l0"
        _lv += f", s{_i} AS (SELECT * FROM (SELECT name, depth FROM {_prev} UNION ALL SELECT DISTINCT b.dst, {_i} FROM b JOIN {_prev} p ON b.src = p.name AND p.depth = {_i - 1} WHERE b.dst NOT IN (SELECT name FROM {_prev})) ORDER BY depth, name LIMIT 500)"
    query(f"gr_03_expand_{_h}", _step.rstrip() + _lv + f"\nSELECT name, depth FROM s{_h}")(lambda k, h=_h: _graph(k).expand("ASIA", h)[0].select("name", "depth"))
    if _h == 2:
        query("join_17_edges_among", _step.rstrip() + _lv + "\nSELECT src, dst, fact_id FROM e WHERE src IN (SELECT name FROM s2) AND dst IN (SELECT name FROM s2)")(lambda k: _graph(k).expand("ASIA", 2)[1].select("src", "dst", "fact_id"))
query(
    "gr_07_explore",
    _with(_EDGES, _DEG, "best AS (SELECT name FROM (SELECT name FROM deg WHERE contains(lower(name), 'nation_1') ORDER BY degree DESC, name LIMIT 10) ORDER BY length(name), name LIMIT 1)")
    + "SELECT name, depth FROM (SELECT name, 0 AS depth FROM best UNION ALL SELECT DISTINCT x, 1 FROM (SELECT dst AS x FROM e JOIN best ON src = name UNION SELECT src FROM e JOIN best ON dst = name) WHERE x NOT IN (SELECT name FROM best)) ORDER BY depth, name LIMIT 500",
)(lambda k: graph.explore(graph.build_edges(k.facts), "nation_1", 1)[0].select("name", "depth"))

# Vectors, full text, fusion
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def _query_vector(k: KnowledgeBase) -> DataFrame:
    return k.embeddings.filter("fact_id = 7").select("embedding")


query("vec_01_search", f"SELECT vec_id AS fact_id, round(list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) DESC, vec_id LIMIT 20")(
    lambda k: vector.search_for(k.embeddings, _query_vector(k)).select("fact_id", F.round("score", 6).alias("score"))
)


def _vectors(k: KnowledgeBase) -> stored_vectors.StoredVectors:
    """The stored vectors: clustered when first asked for, and again when their table changes."""
    made = stored_vectors.StoredVectors(k.spark, runtime.stored_path(k.spark, "vectors", [f"{k.sf_dir}/embeddings.parquet"]))
    return made if made.files.segments() else stored_vectors.build(k.embeddings, made.files.path)


def _vectors_kept_up(k: KnowledgeBase) -> stored_vectors.StoredVectors:
    """Two thirds of the vectors, then the rest; a seventh is removed, a tenth replaced by their opposites, all merged, an eleventh removed."""
    made = stored_vectors.StoredVectors(k.spark, runtime.stored_path(k.spark, "vectors-kept-up", [f"{k.sf_dir}/embeddings.parquet"]))
    if not made.files.segments():
        made.put(k.embeddings.filter("fact_id % 3 <> 0"))
        made.put(k.embeddings.filter("fact_id % 3 = 0"))
        made.remove(k.embeddings.filter("fact_id % 7 = 2"))
        made.put(k.embeddings.filter("fact_id % 10 = 5").withColumn("embedding", F.transform("embedding", lambda x: -x)))
        made.merge()
        made.remove(k.embeddings.filter("fact_id % 11 = 3"))
    return made


def _stored_hits(store: stored_vectors.StoredVectors, k: KnowledgeBase) -> DataFrame:
    asked = _query_vector(k).first()
    return store.search(asked["embedding"] if asked else []).select("fact_id", F.round("score", 6).alias("score"))


query("snk_04_stored_search", ORACLE_SQL["vec_01_search"][len(adapters.SQL) :])(lambda k: _stored_hits(_vectors(k), k))
query(
    "snk_04_kept_up",
    f"SELECT fact_id, round(s, 6) AS score FROM (SELECT vec_id AS fact_id, CASE WHEN vec_id % 10 = 5 THEN -1.0 ELSE 1.0 END * list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS s FROM embeddings WHERE vec_id % 11 <> 3 AND (vec_id % 7 <> 2 OR vec_id % 10 = 5)) ORDER BY s DESC, fact_id LIMIT 20",
)(lambda k: _stored_hits(_vectors_kept_up(k), k))
query("vec_02_dimension", "SELECT vec_id AS fact_id FROM embeddings WHERE len(embedding) = 64")(lambda k: vector.of_dimension(k.embeddings, 64).select("fact_id"))
query("vec_03_remove", "SELECT vec_id AS fact_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM facts WHERE status = 'deleted')")(lambda k: vector.without(k.embeddings, k.facts.filter("status = 'deleted'").select(F.col("id").alias("fact_id"))).select("fact_id"))
query("vec_05_near_dedup")(lambda k: vector.near_dedup(k.embeddings.withColumn("confidence", F.col("fact_id") % 70), 0.35, "label").select("fact_id"))
query("vec_06_embedding_text", "SELECT id, predicate || chr(10) || subject || ' ' || predicate || ' ' || object AS t FROM facts")(lambda k: k.facts.select("id", vector.embedding_text(F.col("predicate"), F.col("subject"), F.col("predicate"), F.col("object"), F.lit("")).alias("t")))
query("vec_08_backfill", "SELECT id, 64 AS n FROM facts WHERE id NOT IN (SELECT vec_id FROM embeddings)")(lambda k: vector.embed(k.facts.join(k.embeddings.select(F.col("fact_id").alias("id")), "id", "left_anti").withColumn("t", F.concat_ws(" ", "subject", "object")), "t").select("id", F.size("embedding").alias("n")))
_TOK = r"list_filter(regexp_split_to_array(lower(subject || ' ' || predicate || ' ' || object || ' ' || title || ' ' || description), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_BM = (
    f"t AS (SELECT id, status, {_TOK} AS t FROM facts), c AS (SELECT id, status, len(t) AS dl, len(list_filter(t, lambda x: x = 'nation')) AS a, len(list_filter(t, lambda x: x = '7')) AS b FROM t), "
    "s AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c), "
    "hits AS (SELECT id, greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)) AS score FROM c, s WHERE a > 0 AND b > 0 AND status = 'active')"
)


def _index(k: KnowledgeBase) -> postings.Index:
    """The stored full-text index of the facts: built when first asked for, and again when their tables change."""
    index = postings.Index(k.spark, k.stored("fulltext"))
    return index if index.segments else postings.build(k.facts, index.path)


_KEPT_UP = (
    "now AS (SELECT id, subject, predicate, CASE WHEN id % 7 = 3 THEN 'NATION_7' ELSE object END AS object, title, description, CASE WHEN id % 10 = 1 THEN 'deleted' ELSE status END AS status FROM facts WHERE id % 5 <> 1)"
)


def _kept_up(k: KnowledgeBase) -> DataFrame:
    """An index of two thirds of the facts that then gets the rest, updates, soft deletes and deletes, one change each, and is merged half way."""
    index = postings.Index(k.spark, k.stored("fulltext-kept-up"))
    if not index.segments:
        f = k.facts
        index.change(put=f.filter("id % 3 <> 0"))
        index.change(put=f.filter("id % 3 = 0"))
        index.change(put=f.filter("id % 7 = 3").withColumn("object", F.lit("NATION_7")), taken=f.filter("id % 7 = 3"))
        index.merge()
        moved = f.withColumn("object", F.when(F.expr("id % 7 = 3"), "NATION_7").otherwise(F.col("object")))
        index.change(put=moved.filter("id % 10 = 1").withColumn("status", F.lit("deleted")), taken=moved.filter("id % 10 = 1"))
        soft = moved.withColumn("status", F.when(F.expr("id % 10 = 1"), "deleted").otherwise(F.col("status")))
        index.change(taken=soft.filter("id % 5 = 1"))
    return index.search("nation 7")


query("fts_05_kept_up", _with(_KEPT_UP, _BM.replace("FROM facts)", "FROM now)", 1)) + "SELECT id, round(score, 6) AS score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 10")(lambda k: _kept_up(k).select("id", F.round("score", 6).alias("score")))
query("fts_05_totals", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest({_TOK}) AS term FROM facts) GROUP BY 1")(lambda k: _index(k).totals())
query("fts_04_bm25", _with(_BM) + "SELECT id, round(score, 6) AS score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 10")(lambda k: _index(k).search('"nation" (7)?').select("id", F.round("score", 6).alias("score")))
query("fts_02_tokens", f"SELECT id, len({_TOK}) AS n FROM facts")(lambda k: k.facts.select("id", F.size(fulltext.tokens(F.concat_ws(" ", *fulltext.FIELDS))).cast("long").alias("n")))
query("fts_05_postings", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOK}) AS term FROM facts) GROUP BY 1, 2) GROUP BY 1")(
    lambda k: fulltext.postings(k.facts, "id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
)


def _fused(k: KnowledgeBase) -> DataFrame:
    hits = _index(k).search("nation 7").withColumnRenamed("id", "fact_id")
    return retrieve.fuse(vector.search_for(k.embeddings, _query_vector(k)), hits, None, k.facts.select(F.col("id").alias("fact_id"), "user_score"), limit=30)


_RET = _with(_BM, f"v AS (SELECT vec_id AS id, list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20)", "h AS (SELECT id, score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 10)").rstrip() + ", fused AS ("
query(
    "ret_01_fusion",
    _with(_BM, f"v AS (SELECT vec_id AS id, list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20)", "h AS (SELECT id, score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 10)")
    + "SELECT p.id AS fact_id, round(sum(part) + max(CASE WHEN f.user_score <> 1 THEN 0.1 * ln(greatest(f.user_score, 0.01)) ELSE 0 END), 6) AS score FROM (SELECT id, 0.5 * s + 0.5 / (60 + row_number() OVER (ORDER BY s DESC, id)) AS part FROM v UNION ALL SELECT id, 0.2 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) FROM h) p LEFT JOIN facts f ON f.id = p.id GROUP BY 1 ORDER BY score DESC, 1 LIMIT 30",
)(lambda k: _fused(k).select("fact_id", F.round("score", 6).alias("score")))
_FUSED = _RET + "SELECT p.id, sum(part) + max(CASE WHEN f.user_score <> 1 THEN 0.1 * ln(greatest(f.user_score, 0.01)) ELSE 0 END) AS score FROM (SELECT id, 0.5 * s + 0.5 / (60 + row_number() OVER (ORDER BY s DESC, id)) AS part FROM v UNION ALL SELECT id, 0.2 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) FROM h) p LEFT JOIN facts f ON f.id = p.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30), hydrated AS (SELECT f.*, score FROM fused JOIN facts f ON f.id = fused.id AND f.status = 'active') "
query("ret_04_seeds", _FUSED + "SELECT name, round(max(score), 6) AS score FROM (SELECT subject AS name, score FROM hydrated UNION ALL SELECT object, score FROM hydrated) GROUP BY 1 ORDER BY max(score) DESC, 1 LIMIT 5")(lambda k: retrieve.seeds(relational.hydrate(_fused(k), k.facts, k.files)).select("name", F.round("score", 6).alias("score")))
query("ret_05_related", _FUSED + "SELECT id AS fact_id, subject, predicate, object, round(score, 4) AS score FROM hydrated ORDER BY hydrated.score DESC, id LIMIT 10")(lambda k: retrieve.related(relational.hydrate(_fused(k), k.facts, k.files)))
query(
    "ret_03_context",
    _FUSED + "SELECT string_agg(concat('[Fact ', b.id, '] ', CASE WHEN title = '' THEN evidence_span ELSE title END, chr(10), '  Source: ', coalesce(path, ''), chr(10), '  Evidence: ', evidence_span, chr(10), CASE WHEN description = '' THEN '' ELSE concat('  Description: ', description, chr(10)) END), chr(10) ORDER BY score DESC, b.id) AS context FROM (SELECT * FROM hydrated ORDER BY score DESC, id LIMIT 8) b LEFT JOIN files ON files.id = b.file_id",
)(lambda k: retrieve.context(relational.hydrate(_fused(k), k.facts, k.files)))


def _asked(k: KnowledgeBase) -> DataFrame:
    """The whole pipeline over the facts that have a vector, with the graph's list."""
    out = retrieve.ask("nation 7", k.facts, k.files, k.embeddings, lambda _: [k.embeddings.filter("fact_id = 7").first()["embedding"]], edges=graph.build_edges(k.facts))
    return k.spark.createDataFrame([(r["fact_id"], r["subject"], r["score"]) for r in out["related"]], "fact_id long, subject string, score double")


query("ret_02_ask")(_asked)

# Text, errors
_D = "documents"
_WORDS = "t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('这是', left(text, 2)) WHEN 1 THEN concat('中文文本', left(text, 40)) WHEN 2 THEN '12 ?!' WHEN 3 THEN concat('。', left(text, 1)) ELSE text END AS t FROM documents)"


def _mixed(k: KnowledgeBase) -> DataFrame:
    """Texts of which some begin with Chinese."""
    return k.spark.sql(f"WITH {_WORDS.replace('FROM documents', 'FROM {docs}')} SELECT * FROM t", docs=k.table(_D))


query("str_01_cjk", "SELECT doc_id, doc_id % 5 IN (0, 1, 3) AS cjk, doc_id % 5 < 2 AS in_names FROM documents")(lambda k: _mixed(k).select("doc_id", text.is_cjk(F.col("t")).alias("cjk"), text.is_cjk(F.col("t"), True).alias("in_names")))
query("str_02_chinese", _with(_WORDS) + r"SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false ELSE (CASE doc_id % 5 WHEN 0 THEN 2 ELSE 4 END) >= 0.5 * len(regexp_extract_all(t, '\pL')) END AS zh FROM t")(lambda k: _mixed(k).select("doc_id", text.detect_chinese(F.col("t")).alias("zh")))
query("str_03_paragraphs", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> '')) AS n FROM documents")(lambda k: k.table(_D).select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("n")))
query(
    "str_04_lines",
    "SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS parts FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS p FROM documents)",
)(lambda k: k.table(_D).select("doc_id", text.lines(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("parts")))
query("str_05_sentences", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS n FROM documents")(
    lambda k: k.table(_D).select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))
)
query(
    "str_07_hard_split",
    "SELECT doc_id, ceil(length(text) / 500)::BIGINT AS n, md5(array_to_string(list_transform(range(ceil(length(text) / 500)::BIGINT), lambda i: substr(text, i * 500 + 1, 500)), '|')) AS parts FROM documents",
)(lambda k: k.table(_D).select("doc_id", text.hard_split(F.col("text"), 500).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("parts")))
query("str_08_chunk")(lambda k: k.table(_D).select("doc_id", F.posexplode(text.chunk_udf(500, 50)(F.col("text"))).alias("i", "content")).select("doc_id", "i", F.length("content").alias("n")))
_CH = "list_filter(string_split(name, ''), lambda x: x <> '')"
_ENT = "ents AS (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part UNION SELECT s_name FROM supplier)"


def _names(k: KnowledgeBase) -> DataFrame:
    return k.table("customer").select(F.col("c_name").alias("name")).union(k.table("part").select("p_name")).union(k.table("supplier").select("s_name")).distinct()


query("str_10_entropy", _with(_ENT) + f"SELECT name, round(list_sum(list_transform(list_distinct({_CH}), lambda x: -(len(list_filter({_CH}, lambda y: y = x)) / length(name)) * log2(len(list_filter({_CH}, lambda y: y = x)) / length(name)))), 6) AS h FROM ents")(
    lambda k: _names(k).select("name", F.round(text.char_entropy(F.col("name")), 6).alias("h"))
)
query("str_12_repeated", _with(_ENT) + f"SELECT name, list_max(list_transform({_CH}, lambda x: len(list_filter({_CH}, lambda y: y = x)))) >= 4 AS r FROM ents")(lambda k: _names(k).select("name", text.has_repeated_chars(F.col("name")).alias("r")))
query("str_11_bigrams", _with(_ENT, "g AS (SELECT name, [name[i:i+1] for i in range(1, length(name))] AS g FROM ents)") + "SELECT name, CASE WHEN length(name) < 4 THEN 0 ELSE round(coalesce(len(list_filter(list_distinct(g), lambda x: len(list_filter(g, lambda y: y = x)) > 1)) / len(list_distinct(g)), 0), 6) END AS r FROM g")(
    lambda k: _names(k).select("name", F.round(text.repeated_ngrams(F.col("name")), 6).alias("r"))
)
query("str_14_gibberish", _with(_ENT) + f"SELECT name, round({_of(_GIBBERISH, 'name')}, 6)::DOUBLE AS g FROM ents")(lambda k: _names(k).select("name", F.round(text.gibberish(F.col("name")), 6).alias("g")))
_ODD = "odd AS (SELECT DISTINCT object AS x FROM facts UNION ALL SELECT unnest(['0.160ng/ml', '50,000元', '+40.00元', '000333', '3.50', '-16,779.87元', '6222080200008516588', '37060219760210161X', '19220010031', '010-58887486', '13812345678', '2024年3月', '2024-01', '2024/1/3', '2024.01.30', '14:30', '365天', '2024', 'HeadwallPhotonics', 'Headwall2Photonics', '华为技术有限公司', '3 apples', '7', ' ', '12/34/5678', '50%', '5 GB', 'x5 GB', '1,2,3', '1e9']))"


def _odd(k: KnowledgeBase) -> DataFrame:
    return k.spark.sql(f"WITH {_ODD.replace('unnest([', 'explode(array(').replace('1e9' + chr(39) + ']))', '1e9' + chr(39) + ')))').replace('FROM facts', 'FROM {facts}')} SELECT x FROM odd", facts=k.facts)


query("str_18_literal", _with(_ODD) + f"SELECT x, {_of(_NUMERIC, 'x')} AS numeric, {_of(_CODE, 'x')} AS code, {_of(_DATE, 'x')} AS date, {_of(_LITERAL, 'x')} AS lit FROM odd")(
    lambda k: _odd(k).select("x", text.numeric_dominant(F.col("x")).alias("numeric"), text.code_like(F.col("x")).alias("code"), text.date_like(F.col("x")).alias("date"), text.is_literal(F.col("x")).alias("lit"))
)
query("str_09_resplit")(lambda k: k.table(_D).select("doc_id", F.posexplode(F.udf(text.resplit, "array<string>")("text")).alias("i", "t")).select("doc_id", "i", F.length("t").alias("n")))
_SIM = "list_distinct(list_filter(string_split(lower(@), ''), lambda x: x <> ''))"
query("str_20_similarity", f"SELECT id, round(CASE WHEN lower(subject) = lower(object) THEN 1 WHEN contains(lower(subject), lower(object)) OR contains(lower(object), lower(subject)) THEN 0.85 ELSE len(list_intersect({_of(_SIM, 'subject')}, {_of(_SIM, 'object')})) / greatest(len({_of(_SIM, 'subject')}), len({_of(_SIM, 'object')})) END, 6)::DOUBLE AS s FROM facts")(
    lambda k: k.facts.select("id", F.round(text.string_similarity(F.col("subject"), F.col("object")), 6).alias("s"))
)
query("str_21_canonical", "SELECT id, CASE WHEN length(object) > length(subject) THEN object ELSE subject END AS name FROM facts")(lambda k: k.facts.select("id", text.canonical_name(F.col("subject"), F.col("object")).alias("name")))
query("str_22_safe_path", "SELECT id, translate(path, '/\\: ', '____') AS p FROM files")(lambda k: k.files.select("id", text.safe_path(F.col("path")).alias("p")))
query("str_23_cut", "SELECT doc_id, left(text, 200) AS t FROM documents")(lambda k: k.table(_D).select("doc_id", text.cut(F.col("text"), 200).alias("t")))
query("err_01_http", "SELECT DISTINCT p_size, CASE WHEN p_size * 15 = 429 THEN 'RATE_LIMIT' WHEN p_size * 15 >= 500 THEN 'MODEL_UNAVAILABLE' ELSE 'UNKNOWN' END AS c FROM part")(lambda k: k.table("part").select("p_size", errors.http_class(F.col("p_size") * 15).alias("c")).distinct())
_SAID = "said AS (SELECT id, CASE id % 9 WHEN 0 THEN 'This model''s maximum context is 32768' WHEN 1 THEN 'Input length exceeded' WHEN 2 THEN 'Rate limit reached' WHEN 3 THEN 'HTTP 429' WHEN 4 THEN 'Request timed out' WHEN 5 THEN 'read TIMEOUT' WHEN 6 THEN 'boom' ELSE 'no such field' END AS m, CASE id % 9 WHEN 7 THEN 'KeyError' WHEN 8 THEN 'ConnectError' END AS kind, CASE WHEN id % 9 = 6 AND id % 2 = 0 THEN 503 END AS code FROM failed_chunks)"
query("err_02_class", "SELECT id, CASE id % 9 WHEN 0 THEN 'CONTEXT_LENGTH_EXCEEDED' WHEN 1 THEN 'CONTEXT_LENGTH_EXCEEDED' WHEN 2 THEN 'RATE_LIMIT' WHEN 3 THEN 'RATE_LIMIT' WHEN 4 THEN 'TIMEOUT' WHEN 5 THEN 'TIMEOUT' WHEN 6 THEN CASE WHEN id % 2 = 0 THEN 'MODEL_UNAVAILABLE' ELSE 'UNKNOWN' END WHEN 7 THEN 'INVALID_JSON' ELSE 'MODEL_UNAVAILABLE' END AS c FROM failed_chunks")(
    lambda k: k.spark.sql(f"WITH {_SAID.replace('FROM failed_chunks', 'FROM {f}').replace(chr(39) * 2, chr(92) + chr(39))} SELECT * FROM said", f=k.failed_chunks).select("id", errors.error_class(F.col("m"), F.col("kind"), F.col("code")).alias("c"))
)
query("err_03_retryable", "SELECT id, error_class IN ('RATE_LIMIT', 'TIMEOUT', 'MODEL_UNAVAILABLE') AS r FROM failed_chunks")(lambda k: k.failed_chunks.select("id", errors.retryable(F.col("error_class")).alias("r")))

# Entities, feedback, lifecycle, streams
query("qa_01_check", _QA + "SELECT name, array_to_string(flags, ',') AS flags, len(flags) >= 2 AS suspect FROM flagged")(lambda k: entities.check(entities.entity_table(k.facts, k.files)).select("name", F.array_join("flags", ",").alias("flags"), "suspect"))
query("qa_02_scan", _QA + "SELECT name, array_to_string(flags, ',') AS flags FROM flagged WHERE len(flags) >= 2")(lambda k: entities.scan(entities.entity_table(k.facts, k.files)).select("name", F.array_join("flags", ",").alias("flags")))
query("qa_03_suspects", _QA + "SELECT name AS entity_a, round(1 - g, 4)::DOUBLE AS confidence, 'proposed' AS status, 'suspect' AS proposal_type FROM flagged WHERE len(flags) >= 2 AND name NOT IN (SELECT entity_a FROM proposals WHERE proposal_type = 'suspect')")(
    lambda k: entities.suspect_proposals(k.facts, k.files, k.proposals).select("entity_a", "confidence", "status", "proposal_type")
)


def _embedded_names(k: KnowledgeBase) -> DataFrame:
    return vector.embed(runtime.materialize(graph.nodes(k.facts), "nodes").repartition("name"), "name", vector.hash_embedder(256))


query("er_01_candidates")(lambda k: entities.merge_candidates(_embedded_names(k)).select("entity_a", "entity_b", F.round("similarity", 6).alias("similarity")))
query("er_02_triage")(lambda k: entities.triage(entities.merge_candidates(_embedded_names(k), 0.7), 0.85, lambda ps: [len(a) == len(b) for a, b in ps]).select("entity_a", "entity_b", "canonical", "status"))
query("er_03_apply")(lambda k: entities.apply_merges(k.facts, entities.triage(entities.merge_candidates(_embedded_names(k)))).select("id", "subject", "object"))
query(
    "fb_01_allocate",
    "SELECT id AS fact_id, round(CASE WHEN i = n THEN 0.3 - coalesce(sum(share) OVER (PARTITION BY file_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share END, 6) AS delta FROM (SELECT id, file_id, floor(0.3::DOUBLE * confidence / sum(confidence::DOUBLE) OVER (PARTITION BY file_id) * 10000 + 0.5::DOUBLE) / 10000 AS share, count(*) OVER (PARTITION BY file_id) AS n, row_number() OVER (PARTITION BY file_id ORDER BY id) AS i FROM facts)",
)(lambda k: entities.allocate(k.facts.select(F.col("id").alias("fact_id"), "file_id", F.col("confidence").cast("double").alias("similarity_score")), 0.3, by="file_id").select("fact_id", F.round("delta", 6).alias("delta")))
_VOTES = "SELECT fact_id, round(list_reduce(list_prepend(1.0::DOUBLE, list(CASE feedback_type WHEN 'positive' THEN 0.7::DOUBLE ELSE -0.7 END ORDER BY id)), lambda s, x: least(2.0, greatest(0.0, s + x))), 6) AS user_score FROM feedback GROUP BY 1"
query("fb_02_votes", _VOTES)(lambda k: entities.fold_votes(k.feedback.select("fact_id", F.col("id").alias("seq"), F.when(F.col("feedback_type") == "positive", 0.7).otherwise(-0.7).alias("delta"))).select("fact_id", F.round("user_score", 6).alias("user_score")))


def _lasting(k: KnowledgeBase) -> DataFrame:
    """Facts under decisions on suppliers: chains of renames, of which some end in a deletion and some were undone."""
    i = F.col("id")
    new = F.when(i % 16 != 7, F.concat(F.lit("Supplier#"), F.lpad((i + 1).cast("string"), 9, "0")))
    own = k.proposals.filter((i % 8).between(1, 6) | (i % 16 == 7)).select(i.alias("seq"), F.when(new.isNull(), "delete").otherwise("rename").alias("kind"), F.col("entity_a").alias("name"), new.alias("new_name"))
    undone = own.filter("seq % 10 = 1").select((F.col("seq") + 10**12).alias("seq"), F.lit("undo").alias("kind"), F.col("seq").alias("target"))
    log = decisions.Decisions(k.spark, f"{runtime.shared_dir(k.spark)}/{k.spark.sparkContext.applicationId}/decisions-{uuid.uuid4().hex}")
    log.take(own.unionByName(undone, allowMissingColumns=True))
    return log.resolve(k.facts)


_FINAL = (
    "dec AS (SELECT s_suppkey AS seq, s_name AS old, CASE WHEN s_suppkey % 16 <> 7 THEN 'Supplier#' || lpad((s_suppkey + 1)::VARCHAR, 9, '0') END AS new FROM supplier WHERE (s_suppkey % 8 BETWEEN 1 AND 6 OR s_suppkey % 16 = 7) AND s_suppkey % 10 <> 1)",
    "fin AS (WITH RECURSIVE w AS (SELECT old AS name, seq, new AS called FROM dec UNION ALL SELECT w.name, d.seq, d.new FROM w JOIN dec d ON d.old = w.called AND d.seq > w.seq) SELECT name, called, true AS told FROM w QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1)",
    "told AS (SELECT f.id, f.subject, f.object, f.status, s.called AS s_at, o.called AS o_at, f.status = 'active' AND (coalesce(s.told AND s.called IS NULL, false) OR coalesce(o.told AND o.called IS NULL, false)) AS gone FROM facts f LEFT JOIN fin s ON s.name = f.subject LEFT JOIN fin o ON o.name = f.object)",
)
query(
    "er_05_lasting",
    _with(*_FINAL) + "SELECT id, CASE WHEN status = 'active' AND NOT gone THEN coalesce(s_at, subject) ELSE subject END AS subject, CASE WHEN status = 'active' AND NOT gone THEN coalesce(o_at, object) ELSE object END AS object, CASE WHEN gone THEN 'deleted' ELSE status END AS status FROM told",
)(lambda k: _lasting(k).select("id", "subject", "object", "status"))


def _cut_answers(k: KnowledgeBase) -> DataFrame:
    """Answers of up to ten facts each, cut at places all over them: what is complete, and where to go on."""
    one = F.concat(F.lit('{"subject": "'), "subject", F.lit('", "predicate": "'), "predicate", F.lit('", "object": "'), "object", F.lit('"}'))
    told = k.facts.groupBy(F.floor(F.col("id") / 10).alias("answer")).agg(F.sort_array(F.collect_list(F.struct("id", one.alias("j")))).alias("js"))
    whole = F.concat(F.lit('{"facts": ['), F.array_join(F.transform("js", lambda x: x["j"]), ", "), F.lit("]}"))
    cut = told.select("answer", whole.alias("t")).withColumn("t", F.expr("substring(t, 1, cast(answer * 37 % (length(t) + 1) AS INT))"))
    return cut.select("answer", truncation.cut_state(F.col("t")).alias("s")).select("answer", F.size("s.facts").alias("n"), "s.resume", "s.whole")


query(
    "ex_02_cut_answers",
    _with(
        """j AS (SELECT id // 10 AS answer, id, length('{"subject": "' || subject || '", "predicate": "' || predicate || '", "object": "' || object || '"}') AS n FROM facts)""",
        "e AS (SELECT answer, 11 + sum(n) OVER w + 2 * (row_number() OVER w - 1) AS until FROM j WINDOW w AS (PARTITION BY answer ORDER BY id))",
        "c AS (SELECT answer, max(until) + 2 AS total, answer * 37 % (max(until) + 3) AS cut FROM e GROUP BY 1)",
    )
    + "SELECT answer, count(*) FILTER (until <= cut) AS n, coalesce(max(until) FILTER (until <= cut), 0)::BIGINT AS resume, any_value(cut = total) AS whole FROM e JOIN c USING (answer) GROUP BY 1",
)(_cut_answers)


def _routed(k: KnowledgeBase) -> DataFrame:
    """The files of each base: one a source, of which the first by name is renamed and the last deleted."""
    kbs = namespaces.Namespaces(k.spark, f"{runtime.shared_dir(k.spark)}/{k.spark.sparkContext.applicationId}/bases-{uuid.uuid4().hex}")
    sources = [r["source"] for r in k.table("documents").select("source").filter("source IS NOT NULL").distinct().orderBy("source").collect()]
    for s in sources:
        kbs.add_directory(f"/kb/{s}", s)
    if sources:
        kbs.rename(sources[0], "renamed")
        if len(sources) > 1:
            kbs.delete(sources[-1])
    return kbs.routed(k.files).groupBy("kb").agg(F.count("*").alias("n"))


query(
    "kb_01_namespaces",
    ", s AS (SELECT min(source) AS a, max(source) AS z FROM documents) SELECT CASE WHEN source = a THEN 'renamed' WHEN source < z THEN source END AS kb, count(*) AS n FROM documents, s GROUP BY 1",
)(_routed)
query("ex_01_extract")(lambda k: lifecycle.extracted_facts(lifecycle.extract(k.chunks)).select("chunk_id", "subject", "object"))
query("ix_03_retry_plan", "SELECT path, CASE WHEN status = 'pending' OR retry_count < 3 THEN 'retry' ELSE 'dead' END AS plan FROM files WHERE status IN ('pending', 'failed')")(lambda k: lifecycle.retry_plan(k.files).select("path", "plan"))
query("rs_02_dead_letters", "SELECT id, CASE WHEN id IN (SELECT id FROM (SELECT * FROM failed_chunks WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= 500) ORDER BY created_at, id LIMIT 10) WHERE error_class IN ('RATE_LIMIT', 'TIMEOUT', 'MODEL_UNAVAILABLE')) THEN 'done' ELSE status END AS status FROM failed_chunks")(
    lambda k: lifecycle.dead_letters(k.failed_chunks, k.chunks, now=500)[1].select("id", "status")
)


def _listing(k: KnowledgeBase) -> DataFrame:
    return k.files.select("path", "sha256", "id").join(k.table("documents").select(F.col("doc_id").alias("id"), "text"), "id").select("path", "sha256", "text")


query("ix_01_run")(lambda k: lifecycle.index_run(_listing(k), k.previous.withColumn("status", F.lit("done")))["facts"].select("subject", "predicate", "object"))


def _indexed(k: KnowledgeBase) -> DataFrame:
    """The files of a stored knowledge base after a run over older texts and one over those of now."""
    base = indexed.IndexedBase(k.spark, f"{runtime.shared_dir(k.spark)}/{k.spark.sparkContext.applicationId}/indexed-{uuid.uuid4().hex}")
    now = _listing(k).select("path", "sha256", "text")
    old = F.pmod(F.xxhash64("path"), F.lit(9)) == 0
    base.run(now.withColumns({"text": F.when(old, "Once it was other.").otherwise(F.col("text")), "sha256": F.when(old, "old").otherwise(F.col("sha256"))}))
    base.run(now)
    return base.table("files").select("path", "sha256", "status")


query("ix_01_stored_run", "SELECT path, sha256, 'done' AS status FROM files")(_indexed)
query("ix_02_changes", "SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN c.sha256 <> p.sha256 THEN 'modified' ELSE 'unchanged' END AS change FROM files c FULL JOIN previous p ON c.path = p.path")(
    lambda k: lifecycle.index_run(_listing(k), k.previous.withColumn("status", F.lit("done")))["changes"]
)


def _streamed(k: KnowledgeBase) -> DataFrame:
    """The votes as a stream of one written table, in one batch."""
    at = f"{runtime.shared_dir(k.spark)}/votes-{uuid.uuid4().hex}"
    votes = k.feedback.select("fact_id", F.col("id").alias("seq"), F.when(F.col("feedback_type") == "positive", 0.7).otherwise(-0.7).alias("delta"))
    votes.write.parquet(f"{at}/in")
    stream = feeds.score_votes(k.spark.readStream.schema(votes.schema).parquet(f"{at}/in"))
    stream.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{at}/out")).outputMode("update").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return k.spark.read.schema("fact_id long, user_score double").parquet(f"{at}/out")


query("stm_03_votes", _VOTES)(lambda k: _streamed(k).select("fact_id", F.round("user_score", 6).alias("user_score")))
query("stm_06_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda k: feeds.windows(k.table("events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"))
query(
    "stm_06_sessions",
    "SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
)(lambda k: feeds.sessions(k.table("events")).select("user_id", "n"))


_DAY = 86400  # rows of 1970's first second would be late


def _timed(k: KnowledgeBase, rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All that a timed job gives for one written table read as a stream; its clock ends at the last row's time."""
    at = f"{runtime.shared_dir(k.spark)}/timed-{uuid.uuid4().hex}"
    rows.write.parquet(f"{at}/in")
    out = build(k.spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
    writer = out.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{at}/out")).outputMode(mode)
    timed.start(writer.option("checkpointLocation", f"{at}/cp").trigger(availableNow=True), k.spark).awaitTermination()
    return k.spark.read.schema(out.schema).parquet(f"{at}/out")


def _actions(k: KnowledgeBase) -> DataFrame:
    """What became of each file's entries over time, one a second; a done entry is a success."""
    events = k.failed_chunks.select(
        F.col("file_id").alias("chunk_id"), F.timestamp_seconds(F.col("created_at") + _DAY).alias("at"), F.when(F.col("status") != "done", F.col("error_class")).alias("error_class"), F.col("retry_count").alias("attempt")
    )
    return _timed(k, events, lambda s: timed.retries(s, budget=3, keep=3600), "append").filter(F.col("at") < F.timestamp_seconds(F.lit(_last(k) + _DAY)))


def _last(k: KnowledgeBase) -> int:
    return k.failed_chunks.agg(F.max("created_at")).first()[0] or 0


query(
    "stm_04_retries",
    """, own AS (SELECT file_id AS chunk_id, created_at AS due, status = 'done' AS ok, retry_count AS attempt, error_class IN ('RATE_LIMIT', 'TIMEOUT', 'MODEL_UNAVAILABLE') AND retry_count < 2 AS again, (SELECT max(created_at) FROM failed_chunks) AS clock,
    lead(created_at) OVER w AS nxt, lag(status <> 'done' AND created_at + 3600 > after) OVER w AS held, lag(retry_count) OVER w AS prior
    FROM (SELECT *, lead(created_at) OVER (PARTITION BY file_id ORDER BY created_at) AS after FROM failed_chunks) WINDOW w AS (PARTITION BY file_id ORDER BY created_at)),
    acts AS (SELECT chunk_id, 'done' AS action, due, prior AS attempt FROM own WHERE ok AND held
    UNION ALL SELECT chunk_id, 'dead', due, attempt FROM own WHERE NOT ok AND NOT again
    UNION ALL SELECT chunk_id, 'retry', due + (1 << attempt), attempt FROM own WHERE NOT ok AND again AND due + (1 << attempt) <= coalesce(nxt, clock)
    UNION ALL SELECT chunk_id, 'expired', due + 3600, attempt FROM own WHERE NOT ok AND due + 3600 <= coalesce(nxt, clock))
    SELECT chunk_id, action, due, attempt FROM acts WHERE due < (SELECT max(created_at) FROM failed_chunks)""",
)(lambda k: _actions(k).select("chunk_id", "action", (F.unix_seconds("at") - _DAY).alias("due"), "attempt"))


def _decayed(k: KnowledgeBase) -> DataFrame:
    """Each fact's score at the end, after votes of either kind, one a second, and a decay every 600 seconds."""
    votes = k.feedback.select("fact_id", F.timestamp_seconds(F.col("id") + _DAY).alias("at"), F.col("id").alias("seq"), F.when(F.col("feedback_type") == "positive", 0.7).otherwise(-0.7).alias("delta"))
    tick = k.feedback.agg((F.floor(F.max("id") / 600) * 600 + 1199).alias("t")).select(F.lit(None).cast("long").alias("fact_id"), F.timestamp_seconds(F.col("t") + _DAY).alias("at"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("delta"))
    out = _timed(k, votes.unionByName(tick), lambda s: timed.decaying_scores(s, rate=0.1, period=600, least=1e-9), "update")
    return out.groupBy("fact_id").agg(F.max_by("user_score", "at").alias("user_score"))


query(
    "stm_04_decay",
    """, v AS (SELECT fact_id, id, CASE feedback_type WHEN 'positive' THEN 0.7::DOUBLE ELSE -0.7 END AS d, id // 600 - lag(id // 600, 1, id // 600) OVER (PARTITION BY fact_id ORDER BY id) AS p FROM feedback),
    s AS (SELECT fact_id, max(id) // 600 AS p, list_reduce(list_prepend({'d': 1.0::DOUBLE, 'p': 0::BIGINT}, list({'d': d, 'p': p} ORDER BY id)), lambda a, x: {'d': least(2.0, greatest(0.0, 1 + (a.d - 1) * power(0.9::DOUBLE, x.p) + x.d)), 'p': 0::BIGINT}).d AS score FROM v GROUP BY 1)
    SELECT fact_id, round(1 + (score - 1) * power(0.9::DOUBLE, (SELECT max(id) // 600 + 1 FROM feedback) - p), 6) AS user_score FROM s""",
)(lambda k: _decayed(k).select("fact_id", F.round("user_score", 6).alias("user_score")))


def _chats(k: KnowledgeBase) -> DataFrame:
    """All turns saved in two batches; every seventh session is deleted in between, and a fifth of what stands is rated at the end."""
    log = chats.ChatLog(k.spark, f"{runtime.shared_dir(k.spark)}/{k.spark.sparkContext.applicationId}/chats-{uuid.uuid4().hex}")
    turns = k.chat.select((F.col("id") + 1).alias("seq"), "kb_name", "session_id", "role", "content", F.timestamp_seconds("created_at").alias("created_at"))
    early = F.col("seq") % 1000 <= 2
    log.save(turns.filter(early))
    log.delete(turns.filter(F.col("session_id").cast("long") % 7 == 0).select("kb_name", "session_id"))
    log.save(turns.filter(~early))
    at = F.unix_seconds("created_at")
    log.rate(log.messages().filter(at % 5 == 0).select(F.col("id").alias("seq"), "id", F.when(at % 10 == 0, "negative").otherwise("positive").alias("feedback_given")))
    return log.messages().select("kb_name", "session_id", "role", "content", at.alias("created_at"), "feedback_given")


query(
    "ch_01_chats",
    "SELECT kb_name, session_id, role, content, created_at, CASE WHEN created_at % 10 = 0 THEN 'negative' WHEN created_at % 5 = 0 THEN 'positive' END AS feedback_given FROM chat WHERE NOT (created_at % 1000 < 2 AND session_id::BIGINT % 7 = 0)",
)(_chats)
