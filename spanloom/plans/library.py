"""More queries by name: loaders and sinks, joins over results, reports, styles. Registered in the catalog."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import scores, session, text
from spanloom.operators import contexts, graph, language, layout, phrases, reports, service, spectra, styling, terms, timeline, vectors
from spanloom.plans.catalog import BACKBONE, ELEMENTS, FREQ, ORACLES, PAIRS, ROOTS, SIGN, SPANS, SQUEEZE, STABLE, STATS, STEM, TALK, TOKENS, _freq, _important, _pairs, _scored, _signatures, _stable, _talk, at, core_score_rank, query, r6, snapshot_pct
from spanloom.plans import run as runs
from spanloom.plans.results import Results
from spanloom.plans.tables import cut, new_path, ranked
from spanloom.sources import files, scan, sinks
from spanloom.streaming import batches


def squeezed(sql: str) -> str:
    return SQUEEZE.replace("{0}", "@").replace("{{2,}}", "{2,}").replace("@", sql)


def r6s(*names: str) -> list:
    return [(r6(c) + 0.0).alias(c) for c in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


# ---------------------------------------------------------------- text and files
@query("WITH s AS (SELECT doc_id, " + squeezed(r"regexp_replace(regexp_replace(text, '\\[A-Za-z]+\{([^}]*)\}', '\1', 'g'), '\\[A-Za-z]+', ' ', 'g')") + " AS t FROM documents) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM s")
def latex_arguments(spark, d):
    t = text.latex_arguments(F.col("text"))
    return at(spark, d, "documents").select("doc_id", F.length(t).alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


CODE = "list_transform(regexp_extract_all(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]{{3,}}'), lambda x: lower(x))"


def code_sql(first: str, second: str) -> str:
    own = CODE.format("text")
    return f"SELECT doc_id, len(regexp_extract_all(text, '{first}', 1)) AS n_lines, len(regexp_extract_all(text, '{second}', 1)) AS n_blocks, len({own}) AS n_words, md5(array_to_string({own}, ' ')) AS digest FROM documents"


def _extracted(spark, d, first, second):
    words = text.code_words(F.col("text"))
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 1))
    return at(spark, d, "documents").select("doc_id", n(first).alias("n_lines"), n(second).alias("n_blocks"), F.size(words).alias("n_words"), F.md5(F.array_join(words, " ").cast("binary")).alias("digest"))


@query(code_sql(r"(?m)#\s*(.*)$", '(?s)"""(.*?)"""'))
def python_source(spark, d):
    return _extracted(spark, d, r"(?m)#\s*(.*)$", '(?s)"""(.*?)"""')


@query(code_sql(r"(?m)//\s*(.*)$", r"(?s)/\*(.*?)\*/"))
def c_source(spark, d):
    return _extracted(spark, d, r"(?m)//\s*(.*)$", r"(?s)/\*(.*?)\*/")


def sql_words(of: str) -> str:
    dropped = ", ".join(f"'{x}'" for x in (*text.RESERVED, *text.NOISE))
    # An acronym before a word gets a blank after it, as this engine's patterns do not look ahead.
    split = r"regexp_extract_all(regexp_replace(n, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Za-z][a-z]+|[A-Z]+(?: |$)|[0-9]+')"
    parts = f"list_transform(flatten(list_transform(regexp_extract_all({of}, '[A-Za-z0-9_]+'), lambda n: CASE WHEN len({split}) > 0 THEN {split} ELSE [n] END)), lambda x: lower(trim(x)))"
    return f"list_filter({parts}, lambda x: (length(x) >= 3 OR x = 'df') AND x NOT IN ({dropped}) AND NOT regexp_full_match(x, '[0-9]+'))"


def sql_quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL_NOTES = f"array_to_string(list_concat(regexp_extract_all(text, {sql_quoted(text.DOCSTRING)}), regexp_extract_all(text, {sql_quoted(text.COMMENT)})), chr(10))"
SQL_BODY = f"regexp_replace(regexp_replace(text, {sql_quoted(text.DOCSTRING)}, ' ', 'g'), {sql_quoted(text.COMMENT)}, ' ', 'g')"
SQL_PATHS = "regexp_replace({0}, " + sql_quoted(text.PATH).replace("{", "{{").replace("}", "}}") + ", ' ', 'g')"
WORDS_SQL = "WITH t AS (SELECT {0} AS id, {1} AS w FROM {2}) SELECT id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM t"


def _digested(words):
    return words.select("id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(WORDS_SQL.format("doc_id", f"list_concat({sql_words(SQL_NOTES)}, {sql_words(SQL_PATHS.format(SQL_BODY))})", "documents"))
def code_tokens(spark, d):
    return _digested(at(spark, d, "documents").select(F.col("doc_id").alias("id"), text.code_tokens(F.col("text")).alias("w")))


@query(WORDS_SQL.format("page_id", sql_words(SQL_PATHS.format("coalesce(html, '')")), "pages"))
def script_tokens(spark, d):
    """The words of another language's source, the markup and scripts of pages."""
    return _digested(at(spark, d, "pages").select(F.col("page_id").alias("id"), text.code_tokens(F.col("html"), "html").alias("w")))


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+') AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM t")
def word_characters(spark, d):
    words = at(spark, d, "documents").select("doc_id", text.word_characters(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(r"""WITH f AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, strlen(text) AS size, regexp_extract_all(lower(substr(text, 1, 16000)), '[\p{L}\p{N}_-]+') AS w FROM documents),
s AS (SELECT path, len(list_filter(w, lambda x: x IN ('the', 'src1', 'of'))) AS overlap, CAST(contains(lower(path), 'the') AS INT) + CAST(contains(lower(path), 'src1') AS INT) + CAST(contains(lower(path), 'of') AS INT) AS hits, size FROM f)
SELECT path, overlap + 1.5 * hits + 2000.0 / (1000.0 + size) AS score FROM s WHERE overlap > 0 ORDER BY score DESC, path LIMIT 20""")
def code_search(spark, d):
    shelf = at(spark, d, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return service.code_search(shelf, "the src1 of", 20)


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY source, doc_id LIMIT 100")
def first_documents(spark, d):
    """The corpus cut to a number of files in order of their paths."""
    return at(spark, d, "documents").orderBy("source", "doc_id").limit(100).select("doc_id", "source", "n_chars")


@query("""WITH p AS (SELECT ['.txt', '.md', '.CSV', '.json', '.tex', '.bin'][doc_id % 6 + 1] AS suffix FROM documents) SELECT lower(suffix) AS suffix, lower(suffix) IN ('.txt', '.md', '.csv', '.json', '.tex') AS is_text, lower(suffix) IN ('.csv', '.json', '.txt') AS is_table, count(*) AS n FROM p GROUP BY ALL""")
def suffix_filters(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".CSV", ".json", ".tex", ".bin"))), (F.col("doc_id") % 6 + 1).cast("int"))
    paths = at(spark, d, "documents").select(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return paths.select(files.suffix_of(F.col("path")).alias("suffix"), files.is_text(F.col("path")).alias("is_text"), files.is_table(F.col("path")).alias("is_table")).groupBy("suffix", "is_text", "is_table").agg(F.count("*").alias("n"))


@query(f"WITH {SPANS} SELECT doc_id, position, row_number() OVER (ORDER BY doc_id, position) - 1 AS span_id FROM spans")
def span_ids(spark, d):
    return ranked(terms.spans(at(spark, d, "documents")).select("doc_id", "position"), F.col("doc_id"), F.col("position")).select("doc_id", "position", (F.col("place") - 1).alias("span_id"))


@query(f"WITH {SPANS}, s AS (SELECT doc_id, substr(string_agg(span, chr(10) ORDER BY position), 1, 15000) AS t FROM spans GROUP BY doc_id) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM s")
def span_texts(spark, d):
    """A document's spans joined again, the first 15,000 characters."""
    joined = at(spark, d, "documents").select("doc_id", text.spans(F.col("text")).alias("s")).filter(F.size("s") > 0).select("doc_id", F.substring(F.array_join("s", "\n"), 1, 15_000).alias("t"))
    return joined.select("doc_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("SELECT count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (text = '') AS empty, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents")
def loading_report(spark, d):
    return at(spark, d, "documents").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text")).alias("n_bytes"), F.count(F.when(F.col("lang").isNull(), 1)).alias("no_lang"), F.count(F.when(F.col("text") == "", 1)).alias("empty"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("""WITH l AS (SELECT l_partkey AS source, l_suppkey AS target, CASE WHEN l_linenumber = 2 THEN 'x' ELSE CAST(l_quantity AS VARCHAR) END AS raw FROM lineitem), c AS (SELECT source, target, coalesce(TRY_CAST(raw AS DOUBLE), 0.0) AS weight FROM l)
SELECT c.* FROM c SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 10) p ON source = p_partkey SEMI JOIN supplier ON target = s_suppkey WHERE source <> target AND weight > 0""")
def loaded_edges(spark, d):
    raw = at(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.when(F.col("l_linenumber") == 2, "x").otherwise(F.col("l_quantity").cast("string")).alias("weight"))
    return graph.valid(graph.coerced(raw), at(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("node")), at(spark, d, "supplier").select(F.col("s_suppkey").alias("node")))


# ---------------------------------------------------------------- sinks, read back
def _edges(spark, d):
    return cut(_pairs(spark, d))


SIDES = f"{PAIRS}, whole AS (SELECT * FROM edges), esides AS (SELECT source AS node, target AS other, weight FROM whole UNION ALL SELECT target, source, weight FROM whole), edeg AS (SELECT node, count(*) AS degree, avg(weight) AS mean_weight FROM esides GROUP BY node)"
GROUPS = f"{SIDES}, grp(node, component) USING KEY (node) AS (SELECT node, node FROM edeg UNION SELECT b.other, min(r.component) FROM grp r JOIN esides b ON r.node = b.node JOIN recurring.grp o ON o.node = b.other WHERE r.component < o.component GROUP BY b.other), sizes AS (SELECT component, count(*) AS size FROM grp GROUP BY 1)"


@query(f"WITH {SIDES} SELECT * FROM whole")
def edges_through_csv(spark, d):
    path = new_path(spark)
    files.write_edges(_edges(spark, d), path)
    return files.table(spark, path, "source long, target long, weight long")


@query(f"WITH {SIDES} SELECT '\"' || source || '\",\"' || target || '\",\"' || weight || '\"' AS line FROM whole")
def edges_quoted(spark, d):
    path = new_path(spark)
    sinks.write_quoted(_edges(spark, d).select("source", "target", "weight"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"WITH RECURSIVE {GROUPS} SELECT 'G' || component AS compound_id, count(*) AS num_elements, min(node) AS least FROM grp GROUP BY component")
def compounds_through_json(spark, d):
    found = graph.components(_edges(spark, d))
    # A record holds about 10,000 members at most; a larger compound has several.
    parts = found.groupBy("component").agg(F.ceil(F.count("*") / 10_000).alias("parts"))
    dealt = found.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    table = dealt.groupBy("component", "part").agg(F.sort_array(F.collect_list(F.col("node").cast("string"))).alias("elements")).select(F.concat(F.lit("G"), "component").alias("compound_id"), "elements")
    path = new_path(spark)
    files.write_compounds(table, path)
    back = sinks.read_records(spark, path, "compound_id string, elements array<string>")
    return back.groupBy("compound_id").agg(F.sum(F.size("elements")).alias("num_elements"), F.min(F.array_min(F.transform("elements", lambda x: x.cast("long")))).alias("least"))


@query(f"WITH {SIGN} SELECT row_number() OVER (ORDER BY element) - 1 AS element_id, element, support, round(bits, 6) AS entropy_bits, dominant_label FROM signs")
def signatures_through_csv(spark, d):
    """Signatures with element ids, ordered by support and entropy, as CSV and back."""
    path = new_path(spark)
    sinks.write_csv(_signatures(spark, d).select("element", "support", r6("entropy_bits").alias("entropy_bits"), "dominant_label"), path, F.desc("support"), "entropy_bits", "element")
    return ranked(files.table(spark, path, "element string, support long, entropy_bits double, dominant_label string"), "element").withColumn("element_id", F.col("place") - 1).drop("place")


@query(f"WITH {STABLE} SELECT element, round(entropy, 6) + 0.0 AS entropy, round(coherence, 6) AS coherence, round(coherence / (1 + greatest(entropy, 0.0)), 6) AS stability FROM coh")
def stability_through_csv(spark, d):
    path = new_path(spark)
    sinks.write_csv(scores.with_stability(_stable(spark, d)).select("element", *r6s("entropy", "coherence", "stability")), path, "element")
    return files.table(spark, path, "element string, entropy double, coherence double, stability double")


@query(f"WITH {STATS} SELECT element, collection_freq, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM stats")
def elements_through_json(spark, d):
    path = new_path(spark)
    sinks.write_records(terms.statistics(at(spark, d, "documents")).select("element", "collection_freq", r6("idf").alias("idf"), r6("tfidf").alias("tfidf")), path)
    return sinks.read_records(spark, path, "element string, collection_freq long, idf double, tfidf double")


@query("SELECT vec_id, label, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 4) AS length FROM embeddings")
def vectors_through_json(spark, d):
    """Vectors as JSON text in a CSV file and back."""
    path = new_path(spark)
    sinks.write_csv(at(spark, d, "embeddings").select("vec_id", "label", F.to_json(F.col("embedding").cast("array<double>")).alias("embedding")), path, "vec_id")
    back = files.vectors(files.table(spark, path, "vec_id long, label int, embedding string"))
    return back.select("vec_id", "label", F.round(scores.dot(F.col("embedding"), F.col("embedding")), 4).alias("length"))


@query("SELECT o_custkey AS signature, o_orderkey AS run_id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def runs_by_signature(spark, d):
    """A run log appended as JSON lines in two parts; of each signature the newest run."""
    path, runs = new_path(spark), at(spark, d, "orders").select(F.col("o_custkey").alias("signature"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created"))
    for k in (0, 1):
        sinks.append_records(runs.filter(F.col("run_id") % 2 == k), path)
    back = sinks.read_records(spark, path, "signature long, run_id long, status string, created long")
    return back.groupBy("signature").agg(F.max_by(F.struct("run_id", "status"), F.struct("created", "run_id")).alias("r")).select("signature", "r.run_id", "r.status")


@query("SELECT event_type AS kind, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS n_chars FROM events GROUP BY 1")
def records_by_kind(spark, d):
    path = new_path(spark)
    sinks.store_by_kind(at(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("props").alias("value")), path)
    return sinks.read_by_kind(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("n_chars"))


def tree_sql(depth: int) -> str:
    """The levels of a Merkle tree by source, t0 with the roots."""
    parts = [f"t{depth} AS (SELECT source, substr(sha256(path), 1, {depth}) AS node, sha256(string_agg(path || ':' || sha, ',' ORDER BY path || ':' || sha)) AS hash, count(*) AS n_files FROM files GROUP BY ALL)"]
    parts += [f"t{k} AS (SELECT source, substr(node, 1, {k}) AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash, CAST(sum(n_files) AS BIGINT) AS n_files FROM t{k + 1} GROUP BY source, substr(node, 1, {k}))" for k in range(depth - 1, -1, -1)]
    return ", ".join(parts)


@query(f"WITH files AS (SELECT CAST(doc_id AS VARCHAR) AS path, source, sha256(text) AS sha FROM documents), {tree_sql(4)} SELECT source, n_files, hash AS digest FROM t0")
def folder_hashes(spark, d):
    """The hash of a folder: the root of a tree over its files' hashes."""
    docs = at(spark, d, "documents")
    files_ = docs.select(F.col("doc_id").cast("string").alias("path"), "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return service.tree(files_, 4, ("source",)).filter("level = 0").select("source", "n_files", F.col("hash").alias("digest"))


def _files(spark, d, body=None):
    """Documents as text files by source, written by the executors: the folder and the rows."""
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".txt").otherwise(".md"))
    rows = at(spark, d, "documents").select(name.alias("path"), F.coalesce("text" if body is None else body, F.lit("")).alias("text"))
    folder = new_path(spark)
    sinks.write_files(rows.filter("text <> ''") if body is not None else rows, folder)
    scan.register(spark)
    return folder, rows


FILES = "f AS (SELECT coalesce(source, 'none') || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'en' THEN '.txt' ELSE '.md' END AS path, coalesce(text, '') AS text FROM documents)"


@query(f"WITH {FILES} SELECT path, '.txt' AS suffix, strlen(text) AS size_bytes, sha256(text) AS digest FROM f WHERE path LIKE '%.txt'")
def scanned_files(spark, d):
    """A folder's files of one suffix by the corpus data source."""
    folder, _ = _files(spark, d)
    return spark.read.format("corpus_files").option("suffixes", "txt").load(folder).select("path", "suffix", "size_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(f"WITH {FILES} SELECT path, strlen(text) AS size_bytes, sha256(text) AS digest FROM f ORDER BY path LIMIT 150")
def scanned_first(spark, d):
    """The first files of a folder by path; no other is opened."""
    folder, _ = _files(spark, d)
    return spark.read.format("corpus_files").option("max_docs", 150).option("partition_bytes", 200_000).load(folder).select("path", "size_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(f"WITH {FILES}, g AS (SELECT path, text, regexp_replace(replace(text, '@', '#'), '[0-9]{{3}}-', '', 'g') AS clean FROM f) SELECT path, CASE WHEN clean = '' THEN 'missing' WHEN strlen(clean) <> strlen(text) THEN 'size' ELSE 'hash' END AS status FROM g WHERE clean <> text OR clean = ''")
def verified_tree(spark, d):
    """A folder of texts without addresses and numbers against the list of raw ones: what that has changed is found from the roots of two trees."""
    folder, _ = _files(spark, d, F.regexp_replace(F.replace("text", F.lit("@"), F.lit("#")), "[0-9]{3}-", ""))
    raw = cut(service.manifest(at(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".txt").otherwise(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text")), "path", "text"))
    there = cut(service.manifest(spark.read.format("corpus_files").load(folder), "path", "text"))
    return service.verify_tree(raw, there, cut(service.tree(raw)), cut(service.tree(there)))


# ---------------------------------------------------------------- graph tables
@query(f"WITH RECURSIVE {GROUPS}, big AS (SELECT * FROM sizes WHERE size >= 4) SELECT g.node, g.component FROM grp g WHERE (SELECT count(*) FROM big) = 0 OR g.component IN (SELECT component FROM big)")
def large_components(spark, d):
    return graph.large_components(cut(graph.components(_edges(spark, d))), 4)


MOLECULES = f"""{GROUPS}, base AS (SELECT h.node, g.component, h.degree, h.mean_weight AS local_stability, p_size / 50.0 AS entropy, p_retailprice / 2500.0 AS coherence, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS info, CASE WHEN p_partkey % 3 = 1 THEN 1.0 ELSE 0.0 END AS mis, CASE WHEN p_partkey % 3 = 2 THEN 1.0 ELSE 0.0 END AS dis FROM edeg h JOIN grp g ON h.node = g.node JOIN part ON p_partkey = h.node),
mols AS (SELECT *, CASE WHEN max(entropy - coherence) OVER () - min(entropy - coherence) OVER () < 1e-9 THEN 0.5 ELSE (entropy - coherence - min(entropy - coherence) OVER ()) / (max(entropy - coherence) OVER () - min(entropy - coherence) OVER () + 1e-9) END AS temperature FROM base),
bonds AS (SELECT s.component, count(*) AS num_bonds, avg(weight) AS w FROM whole e JOIN grp s ON e.source = s.node JOIN grp t ON e.target = t.node WHERE s.component = t.component GROUP BY 1),
comp AS (SELECT m.component, count(DISTINCT m.node) AS num_elements, coalesce(max(num_bonds), 0) AS num_bonds, coalesce(max(w), avg(local_stability)) AS compound_stability, avg(local_stability) AS mean_local_stability, avg(temperature) AS mean_temperature, avg(info) AS mean_info, avg(mis) AS mean_misinfo, avg(dis) AS mean_disinfo, avg(coherence) AS mean_coherence, var_pop(local_stability) AS stability_variance FROM mols m LEFT JOIN bonds b ON m.component = b.component GROUP BY m.component)"""
COMPOUND = ("compound_stability", "mean_local_stability", "mean_temperature", "mean_info", "mean_misinfo", "mean_disinfo", "mean_coherence", "stability_variance")


def _molecules(spark, d):
    edges = _edges(spark, d)
    stable = graph.ends(edges, "weight").groupBy("node").agg(F.count("*").alias("degree"), F.avg("weight").alias("local_stability"))
    third = lambda k: F.when(F.col("node") % 3 == k, 1.0).otherwise(0.0)
    part = at(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 50.0).alias("entropy"), (F.col("p_retailprice") / 2500.0).alias("coherence"))
    nodes = stable.join(graph.components(edges), "node").join(part, "node").withColumns({"info": third(0), "mis": third(1), "dis": third(2)})
    return edges, cut(scores.with_temperature(cut(nodes)))


@query(f"WITH RECURSIVE {MOLECULES} SELECT component, num_elements, num_bonds, {sql6(*COMPOUND)} FROM comp")
def compound_aggregates(spark, d):
    """Every value of a compound: sizes, bonds inside, stability with its fallback, temperature, regimes, coherence, variance."""
    return graph.compound_aggregates(*_molecules(spark, d)).select("component", "num_elements", "num_bonds", *r6s(*COMPOUND))


@query(f"WITH RECURSIVE {MOLECULES} SELECT component, num_elements, round(compound_stability, 6) AS compound_stability FROM comp ORDER BY round(compound_stability, 9) DESC, num_elements DESC, component LIMIT 20")
def top_compounds(spark, d):
    return graph.compound_aggregates(*_molecules(spark, d)).orderBy(F.desc(F.round("compound_stability", 9)), F.desc("num_elements"), "component").limit(20).select("component", "num_elements", r6("compound_stability").alias("compound_stability"))


@query(f"WITH RECURSIVE {MOLECULES} SELECT c.component, num_elements, num_bonds, (SELECT min_by(node, (-degree, node)) FROM mols m WHERE m.component = c.component) AS main_element, round(mean_info / CASE WHEN mean_info + mean_misinfo + mean_disinfo = 0 THEN 1 ELSE mean_info + mean_misinfo + mean_disinfo END, 6) AS info_share FROM comp c")
def compound_profile(spark, d):
    edges, nodes = _molecules(spark, d)
    main = nodes.groupBy("component").agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("main_element"))
    total = F.col("mean_info") + F.col("mean_misinfo") + F.col("mean_disinfo")
    return graph.compound_aggregates(edges, nodes).join(main, "component").select("component", "num_elements", "num_bonds", "main_element", r6(F.col("mean_info") / F.when(total == 0, 1.0).otherwise(total)).alias("info_share"))


@query(f"WITH RECURSIVE {GROUPS}, one AS (SELECT component FROM sizes ORDER BY size DESC, component LIMIT 1), inside AS (SELECT node FROM grp WHERE component IN (SELECT component FROM one)), o AS (SELECT * FROM occ WHERE l_partkey IN (SELECT node FROM inside)) SELECT a.l_partkey AS source, b.l_partkey AS target, count(*) AS weight FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL")
def decomposition(spark, d):
    """The co-occurrences once more, of the elements of the largest compound only."""
    found = cut(graph.components(_edges(spark, d)))
    one = found.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    inside = found.join(F.broadcast(one), "component").select(F.col("node").alias("l_partkey"))
    return graph.cooccurrence(at(spark, d, "lineitem").join(inside, "l_partkey", "left_semi"), "l_orderkey", "l_partkey")


@query(f"WITH {PAIRS}, ids AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part WHERE p_size > 5) SELECT source, target, coalesce(a.id, -1) AS source_id, coalesce(b.id, -1) AS target_id FROM edges LEFT JOIN ids a ON source = a.p_partkey LEFT JOIN ids b ON target = b.p_partkey")
def edges_with_ids(spark, d):
    ids = cut(ranked(at(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("node")), "node").select("node", (F.col("place") - 1).alias("id")))
    side = lambda name: ids.select(F.col("node").alias(name), F.col("id").alias(f"{name}_id"))
    both = _pairs(spark, d).join(side("source"), "source", "left").join(side("target"), "target", "left")
    return both.select("source", "target", *[F.coalesce(F.col(f"{s}_id"), F.lit(-1)).alias(f"{s}_id") for s in ("source", "target")])


@query(f"WITH {PAIRS} SELECT source, target, weight FROM edges ORDER BY weight DESC, source, target LIMIT 25000")
def edges_capped(spark, d):
    return _pairs(spark, d).orderBy(F.desc("weight"), "source", "target").limit(25_000)


@query(f"WITH {SIDES}, few AS (SELECT node FROM edeg ORDER BY degree DESC, node LIMIT 5) SELECT s.node, s.other, s.weight FROM esides s SEMI JOIN few f ON s.node = f.node")
def neighbours(spark, d):
    edges = _edges(spark, d)
    return graph.neighbours(edges, graph.degree(edges).orderBy(F.desc("degree"), "node").limit(5).select("node"))


@query(f"WITH {SIDES}, df AS (SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY 1), w AS (SELECT b.node, b.other FROM esides b JOIN edeg x ON b.node = x.node AND x.degree = 2 JOIN edeg y ON b.other = y.node AND y.degree = 2) SELECT p_partkey AS node, h.degree IS NULL AS is_isolate, coalesce(h.degree = 1, false) AS is_leaf, coalesce(h.degree = 1 AND df.df <= 0.8 * (SELECT avg(df) FROM df), false) AS is_rare_leaf, p_partkey IN (SELECT node FROM w) AS in_chain FROM part LEFT JOIN edeg h ON p_partkey = h.node LEFT JOIN df ON p_partkey = df.node")
def structure_tags(spark, d):
    edges = _edges(spark, d)
    freq = at(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.countDistinct("l_orderkey").alias("df"))
    return graph.structure(at(spark, d, "part").select(F.col("p_partkey").alias("node")), edges, cut(freq), 0.8)


@query("SELECT 'median' AS mode, count(*) AS n FROM (" + ORACLES["prune_median"] + ") a UNION ALL SELECT 'thermal', count(*) FROM (" + ORACLES["prune_thermal"] + ") b UNION ALL SELECT 'topk', count(*) FROM (" + ORACLES["prune_topk"] + ") c UNION ALL SELECT 'none', count(*) FROM (" + ORACLES["cooccurrence_edges"] + ") e")
def pruned_by_mode(spark, d):
    edges, _ = _important(spark, d)
    counts = [graph.pruned(edges, mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("n")) for mode in ("median", "thermal", "topk", "none")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("WITH s AS (" + ORACLES["snapshot_pct"] + ") SELECT pct, n_nodes, n_edges, round(CASE WHEN n_nodes > 1 THEN 2.0 * n_edges / (n_nodes * (n_nodes - 1)) ELSE 0.0 END, 6) AS density, round(2.0 * n_edges / n_nodes, 6) AS mean_degree FROM s")
def snapshot_stats(spark, d):
    n, m = F.col("n_nodes"), F.col("n_edges")
    return snapshot_pct(spark, d).select("pct", "n_nodes", "n_edges", r6(F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0)).alias("density"), r6(2.0 * m / n).alias("mean_degree"))


@query(f"WITH RECURSIVE {GROUPS}, m AS (SELECT count(*) AS n_edges FROM whole) SELECT (SELECT count(*) FROM edeg) AS n_nodes, n_edges, round(2.0 * n_edges / (SELECT count(*) FROM edeg), 6) AS mean_degree, (SELECT count(*) FROM sizes) AS n_components, (SELECT max(size) FROM sizes) AS largest FROM m")
def graph_report(spark, d):
    edges = _edges(spark, d)
    sizes = graph.components(edges).groupBy("component").agg(F.count("*").alias("size")).agg(F.sum("size").alias("n_nodes"), F.count("*").alias("n_components"), F.max("size").alias("largest"))
    return sizes.crossJoin(edges.agg(F.count("*").alias("n_edges"))).select("n_nodes", "n_edges", r6(2.0 * F.col("n_edges") / F.col("n_nodes")).alias("mean_degree"), "n_components", "largest")


@query(f"WITH RECURSIVE {GROUPS} SELECT p_partkey AS node, CASE WHEN s.size >= 3 THEN 'C' || g.component WHEN p_size > 25 THEN 'R' || p_brand WHEN g.component IS NOT NULL THEN 'K' || g.component ELSE 'K000' END AS cluster_id FROM part LEFT JOIN grp g ON p_partkey = g.node LEFT JOIN sizes s ON g.component = s.component")
def cluster_ids(spark, d):
    """The first that a node has: a compound of three and more, a root, a component, none."""
    found = cut(graph.components(_edges(spark, d)))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    j = at(spark, d, "part").join(found.join(sizes, "component"), F.col("p_partkey") == F.col("node"), "left")
    return j.select(F.col("p_partkey").alias("node"), F.coalesce(F.when(F.col("size") >= 3, F.concat(F.lit("C"), "component")), F.when(F.col("p_size") > 25, F.concat(F.lit("R"), "p_brand")), F.concat(F.lit("K"), "component"), F.lit("K000")).alias("cluster_id"))


@query(f"WITH {SIDES}, strong AS (SELECT node, avg(weight) AS mean_weight FROM esides WHERE weight >= 2 GROUP BY 1), full_ AS (SELECT node, avg(weight) AS s FROM esides GROUP BY 1) SELECT p_partkey AS node, round(coalesce(h.mean_weight, f.s), 6) AS stability, CASE WHEN h.node IS NOT NULL THEN 'heavy' WHEN f.node IS NOT NULL THEN 'all' ELSE 'none' END AS source FROM part LEFT JOIN strong h ON p_partkey = h.node LEFT JOIN full_ f ON p_partkey = f.node")
def preferred_stability(spark, d):
    """Of two sources the preferred one where it has the element."""
    pairs = cut(_pairs(spark, d))
    mean = lambda e, name: graph.ends(e, "weight").groupBy("node").agg(F.avg("weight").alias(name))
    nodes = at(spark, d, "part").select(F.col("p_partkey").alias("node")).join(mean(pairs.filter("weight >= 2"), "a"), "node", "left").join(mean(pairs, "b"), "node", "left")
    return nodes.select("node", r6(F.coalesce("a", "b")).alias("stability"), F.when(F.col("a").isNotNull(), "heavy").when(F.col("b").isNotNull(), "all").otherwise("none").alias("source"))


# ---------------------------------------------------------------- styles
def norm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-12 THEN 0.0 ELSE ({c} - min({c}) OVER ()) / CAST(max({c}) OVER () - min({c}) OVER () AS DOUBLE) END"


NODES = f"""{BACKBONE}, lines AS (SELECT l_partkey AS node, count(*) AS tf, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY 1),
nodes AS (SELECT d.node, degree, tf, df, p_retailprice / 2500.0 AS coherence, p_retailprice / 2500.0 / (1 + p_size / 50.0) AS stability FROM degrees d JOIN lines l ON d.node = l.node JOIN part ON p_partkey = d.node),
units AS (SELECT node, {norm("degree")} AS d, {norm("tf")} AS t, {norm("coherence")} AS c, {norm("stability")} AS s, {norm("df")} AS f FROM nodes)"""


def _nodes(spark, d):
    lines = at(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("tf"), F.countDistinct("l_orderkey").alias("df"))
    part = at(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_retailprice") / 2500.0).alias("coherence"), F.col("p_size"))
    return cut(graph.degree(_scored(spark, d)).join(lines, "node").join(part, "node").select("node", "degree", "tf", "df", "coherence", (F.col("coherence") / (1 + F.col("p_size") / 50.0)).alias("stability")))


@query(f"""WITH {NODES}, raw AS (SELECT *, 0.40 * d + 0.30 * t + 0.30 * c AS r FROM units), imp AS (SELECT *, {norm("r")} AS importance FROM raw),
placed AS (SELECT *, row_number() OVER (ORDER BY round(0.40 * importance + 0.30 * s + 0.30 * d, 9) DESC, node) <= greatest(10, floor(0.05 * count(*) OVER ())) AS is_primary FROM imp)
SELECT node, round(importance, 6) AS importance, round(30.0 + 120.0 * importance, 5) AS size, round(1.2 + 2.3 * s, 6) AS halo, round(0.25 + 0.60 * f, 6) AS alpha, round((0.50 + 0.45 * s) * (0.9 - 0.4 * c), 6) AS saturation, round(0.55 + 0.40 * importance, 6) AS value, is_primary AS "primary" FROM placed""")
def node_styles(spark, d):
    return styling.node_styles(_nodes(spark, d)).select("node", *[r6(c).alias(c) for c in ("importance", "halo", "alpha", "saturation", "value")], F.round("size", 5).alias("size"), "primary")


@query(f"WITH {NODES}, raw AS (SELECT node, 0.25 * d + 0.30 * t + 0.25 * c + 0.20 * s AS r FROM units) SELECT node, round({norm('r')}, 6) AS importance FROM raw")
def depth_importance(spark, d):
    return styling.depth_importance(_nodes(spark, d)).select("node", r6("importance").alias("importance"))


@query(f"WITH {SIDES}, u AS (SELECT source, target, {norm('weight')} AS w FROM whole) SELECT source, target, round(0.15 + 2.3 * pow(w, 0.8), 6) AS width, round(0.25 + 0.75 * pow(w, 0.7), 6) AS alpha FROM u")
def edge_styles(spark, d):
    return styling.edge_styles(_edges(spark, d)).select("source", "target", *[r6(c).alias(c) for c in ("width", "alpha")])


@query("""WITH h AS (SELECT p_partkey AS node, p_size / 50.0 AS hue, 0.5 + p_size / 200.0 AS s, 0.9::DOUBLE AS v FROM part), k AS (SELECT *, (hue - floor(hue)) * 6.0 AS h6 FROM h), f AS (SELECT *, CAST(floor(h6) AS BIGINT) % 6 AS i, h6 - floor(h6) AS f FROM k), c AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM f)
SELECT node, CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END AS r, CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END AS g, CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END AS b, 1.0::DOUBLE AS a FROM c""")
def node_colours(spark, d):
    colour = styling.rgba(F.col("p_size") / 50.0, 0.5 + F.col("p_size") / 200.0, F.lit(0.9))
    return at(spark, d, "part").select(F.col("p_partkey").alias("node"), *[c.alias(k) for k, c in colour.items()])


@query(f"""WITH {BACKBONE}, s AS (SELECT min(degree) AS lo, max(degree) AS hi, least(60, greatest(15, floor(sqrt(count(*))) + 5)) AS bins FROM degrees), b AS (SELECT CASE WHEN hi > lo THEN least(bins - 1, floor((degree - lo) / ((hi - lo) / CAST(bins AS DOUBLE)))) ELSE 0 END AS bin, lo, hi, bins FROM degrees, s)
SELECT CAST(bin AS BIGINT) AS bin, round(max(lo + bin * ((hi - lo) / CAST(bins AS DOUBLE))), 6) AS low, count(*) AS n FROM b GROUP BY bin""")
def degree_histogram(spark, d):
    return styling.histogram(graph.degree(_scored(spark, d)), "degree").select("bin", r6("low").alias("low"), "n")


# ---------------------------------------------------------------- elements and documents
@query(f"""WITH {STABLE}, k AS (SELECT c.*, array_to_string(list_transform(string_split(element, ' '), lambda w: {{stem}}), ' ') AS root_key FROM coh c)
SELECT root_key, count(*) AS size, CAST(sum(collection_freq) AS BIGINT) AS total_freq, CAST(sum(span_freq) AS BIGINT) AS total_spans, round(avg(entropy), 6) + 0.0 AS mean_entropy, round(avg(coherence), 6) AS mean_coherence FROM k GROUP BY root_key""".replace("{stem}", STEM))
def root_metrics(spark, d):
    keyed = _stable(spark, d).withColumn("root_key", text.root_key(F.col("element")))
    return keyed.groupBy("root_key").agg(F.count("*").alias("size"), F.sum("collection_freq").alias("total_freq"), F.sum("span_freq").alias("total_spans"), (r6(F.avg("entropy")) + 0.0).alias("mean_entropy"), r6(F.avg("coherence")).alias("mean_coherence"))


@query(f"WITH {STABLE}, c AS (SELECT element, CASE WHEN coherence >= 0.1 THEN coherence END AS x, entropy FROM coh) SELECT count(DISTINCT element) AS n_elements, count(x) AS n_finite, round(avg(x), 6) AS mean_coherence, round(avg(entropy), 6) AS mean_entropy FROM c")
def export_info(spark, d):
    """Means that leave out what is not a number."""
    x = scores.finite(F.when(F.col("coherence") < 0.1, F.lit(float("nan"))).otherwise(F.col("coherence")))
    return _stable(spark, d).withColumn("x", x).agg(F.countDistinct("element").alias("n_elements"), F.count("x").alias("n_finite"), r6(F.avg("x")).alias("mean_coherence"), r6(F.avg("entropy")).alias("mean_entropy"))


@query(f"""WITH {STABLE}, f AS (SELECT w.doc_id, avg(c.entropy) AS e, avg(c.coherence) AS c FROM weights w JOIN coh c ON w.element = c.element GROUP BY w.doc_id) SELECT doc_id, round({norm("e")}, 6) AS entropy, round({norm("c")}, 6) AS coherence FROM f""")
def document_field(spark, d):
    made = terms.span_weights(at(spark, d, "documents"))
    weighted = terms.exploded(*made)
    # The vocabulary bounds what is broadcast.
    means = weighted.join(F.broadcast(_stable(spark, d, made).select("element", "entropy", "coherence")), "element").groupBy("doc_id").agg(F.avg("entropy").alias("e"), F.avg("coherence").alias("c"))
    return styling.unit(cut(means), entropy=F.col("e"), coherence=F.col("c")).select("doc_id", *[r6(c).alias(c) for c in ("entropy", "coherence")])


@query(f"WITH {TOKENS}, u AS (SELECT doc_id, unnest(tokens) AS element FROM tokened), c AS (SELECT doc_id, element, count(*) AS n FROM u GROUP BY ALL) SELECT doc_id, element, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, element) AS place FROM c QUALIFY place <= 5")
def document_elements(spark, d):
    counts = terms.elements(at(spark, d, "documents"), phrases=False).groupBy("doc_id", "element").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "element"))).filter("place <= 5")


@query(f"WITH {TOKENS}, o AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 5) AS BIGINT) AS batch FROM documents) SELECT o.batch, count(DISTINCT o.doc_id) AS n_docs, count(t.position) AS n_spans, CAST(coalesce(sum(len(t.tokens)), 0) AS BIGINT) AS n_tokens FROM o LEFT JOIN tokened t ON o.doc_id = t.doc_id GROUP BY 1")
def batches_of_five(spark, d):
    """Files in order, five to a batch, each batch's counts, all batches together."""
    docs = at(spark, d, "documents")
    order = ranked(docs.select("doc_id"), "doc_id").select("doc_id", F.floor((F.col("place") - 1) / 5).alias("batch"))
    spans = terms.tokenised(docs, phrases=False).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.size("elements")).alias("tokens"))
    return order.join(spans, "doc_id", "left").groupBy("batch").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("spans"), F.lit(0)).alias("n_spans"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))


@query(f"WITH {TOKENS}, u AS (SELECT doc_id, position, unnest(list_distinct(tokens)) AS element FROM tokened), top AS (SELECT element FROM (SELECT unnest(tokens) AS element FROM tokened) GROUP BY element ORDER BY count(*) DESC, element LIMIT 500) SELECT u.element, row_number() OVER (PARTITION BY u.element ORDER BY doc_id, position) AS place, doc_id, position FROM u JOIN top ON u.element = top.element QUALIFY place <= 3")
def example_spans(spark, d):
    tokens = cut(terms.tokenised(at(spark, d, "documents"), phrases=False))
    targets = tokens.select(F.explode("elements").alias("element")).groupBy("element").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element").limit(500).select("element")
    return contexts.examples(tokens, targets)


@query(f"""WITH {ELEMENTS}, top AS (SELECT element FROM elements WHERE length(element) > 1 GROUP BY element ORDER BY count(*) DESC, element LIMIT 500),
low AS (SELECT doc_id, position, chr(1) || regexp_replace(lower(span), '[^\\p{{L}}\\p{{N}}_ ]', chr(1), 'g') || chr(1) AS t FROM spans),
held AS (SELECT doc_id, position, element FROM low JOIN top ON contains(t, element) WHERE contains(t, ' ' || element || ' ') OR contains(t, ' ' || element || chr(1)) OR contains(t, chr(1) || element || ' ') OR contains(t, chr(1) || element || chr(1)))
SELECT element, row_number() OVER (PARTITION BY element ORDER BY doc_id, position) AS place, doc_id, position FROM held QUALIFY place <= 3""")
def example_phrases(spark, d):
    """The first spans whose text has an element, phrases too, as whole words."""
    docs = at(spark, d, "documents")
    targets = terms.frequencies(terms.tokenised(docs)).orderBy(F.desc("collection_freq"), "element").limit(500)
    return phrases.text_examples(terms.spans(docs), targets)


@query(ORACLES["element_frequencies"])
def batched_elements(spark, d):
    """Element frequencies merged from a stream of document files, a few files a batch; a batch that comes again changes nothing."""
    merged, folder = _batched(spark, d)
    merged.elements.compact()
    merged.sizes.compact()
    merged.merge(at(spark, folder, "docs"), 0)
    return merged.elements.read().select("element", "collection_freq", "span_freq")


@query(f"WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n_spans, sum(len(tokens)) AS n_tokens FROM tokened GROUP BY 1) SELECT source, count(*) AS n_docs, CAST(coalesce(sum(n_spans), 0) AS BIGINT) AS n_spans, CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS n_tokens FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY source")
def batched_sizes(spark, d):
    """The corpus' sizes by source, merged the same way."""
    return _batched(spark, d)[0].sizes.read()


def _batched(spark, d):
    folder = new_path(spark)
    docs = at(spark, d, "documents").select("doc_id", "text", "source")
    # A batch has a file for each core, five at least, and grows with the corpus: a larger one has no more batches.
    at_once = max(5, spark.sparkContext.defaultParallelism)
    docs.write.option("maxRecordsPerFile", batches.rows_a_file(docs.count(), at_once)).parquet(f"{folder}/docs.parquet")
    merged = batches.CorpusBatches(spark, new_path(spark), every=4)
    merged.follow(batches.document_files(spark, f"{folder}/docs.parquet", docs.schema.simpleString()[7:-1].replace(":", " "), at_once))
    return merged, folder


KNESER = f"""{TALK}, grams AS (SELECT * FROM (SELECT doc_id, word AS g1, lead(word, 1) OVER x AS g2, lead(word, 2) OVER x AS g3 FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY place)) y WHERE g3 IS NOT NULL),
c3 AS (SELECT g1, g2, g3, count(*) AS n3 FROM grams GROUP BY ALL), c2 AS (SELECT g2, g3, count(*) AS n2 FROM c3 GROUP BY ALL), c1 AS (SELECT g3, count(*) AS n1 FROM c2 GROUP BY ALL),
h3 AS (SELECT g1, g2, sum(n3) AS s3, count(*) AS k3 FROM c3 GROUP BY ALL), h2 AS (SELECT g2, sum(n2) AS s2, count(*) AS k2 FROM c2 GROUP BY ALL), h1 AS (SELECT sum(n1) AS s1, count(*) AS k1 FROM c1),
p AS (SELECT c3.g1, c3.g2, c3.g3, (n3 - 0.75 + 0.75 * k3 * ((n2 - 0.75 + 0.75 * k2 * ((n1 - 0.75 + 0.75 * k1 / (k1 + 1.0)) / s1)) / s2)) / s3::DOUBLE AS p
  FROM c3 JOIN c2 ON c3.g2 = c2.g2 AND c3.g3 = c2.g3 JOIN c1 ON c3.g3 = c1.g3 JOIN h3 ON c3.g1 = h3.g1 AND c3.g2 = h3.g2 JOIN h2 ON c3.g2 = h2.g2, h1)"""


@query(f"WITH {KNESER} SELECT doc_id, round(exp(-avg(ln(p))), 4) AS perplexity, count(*) AS n_words FROM grams g JOIN p ON g.g1 = p.g1 AND g.g2 = p.g2 AND g.g3 = p.g3 GROUP BY doc_id")
def kneser_ney_perplexity(spark, d):
    grams = cut(language.trigrams(_talk(spark, d)))
    return language.KneserNey(grams).perplexity(grams).select("doc_id", F.round("perplexity", 4).alias("perplexity"), "n_words")


@query(f"""WITH {KNESER}, best AS (SELECT g1, g2, g3, round(ln(p), 9) AS lp FROM p QUALIFY row_number() OVER (PARTITION BY g1, g2 ORDER BY round(ln(p), 9) DESC, g3) <= 3),
one AS (SELECT g1, g2, g2 AS u, g3 AS v, g3 AS words, lp AS score FROM best),
two AS (SELECT o.g1, o.g2, o.words || ' ' || b.g3 AS words, round(o.score + b.lp, 9) AS score FROM one o JOIN best b ON o.u = b.g1 AND o.v = b.g2)
SELECT g1, g2, words, round(score, 6) AS score, row_number() OVER (PARTITION BY g1, g2 ORDER BY score DESC, words) AS place FROM two QUALIFY row_number() OVER (PARTITION BY g1, g2 ORDER BY two.score DESC, words) <= 3""".replace("round(score, 6) AS score, row_number() OVER (PARTITION BY g1, g2 ORDER BY score DESC, words) AS place FROM two", "round(two.score, 6) AS score, row_number() OVER (PARTITION BY g1, g2 ORDER BY two.score DESC, words) AS place FROM two"))
def suggested_words(spark, d):
    """For all two words in a row the three best continuations of two words."""
    model = language.KneserNey(language.trigrams(_talk(spark, d)))
    return model.suggestions(model.three.select("g1", "g2").distinct()).select("g1", "g2", "place", "words", r6("score").alias("score"))


@query(f"""WITH {SIGN}, f AS (SELECT tokens[i] || ' ' || tokens[i + 1] AS element FROM (SELECT tokens, unnest(range(1, len(tokens))) AS i FROM tokened) x), n AS (SELECT element FROM f GROUP BY element HAVING count(*) >= 2), t AS (SELECT element, unnest(string_split(element, ' ')) AS token FROM n)
SELECT t.element, round(avg(coalesce(a, 0.0)), 6) AS p_information, round(avg(coalesce(b, 0.0)), 6) AS p_misinformation, round(avg(coalesce(c, 0.0)), 6) AS p_disinformation FROM t LEFT JOIN signs s ON t.token = s.element GROUP BY t.element""")
def phrase_regimes(spark, d):
    names = ["p_information", "p_misinformation", "p_disinformation"]
    phrases = terms.elements(at(spark, d, "documents")).filter(F.col("element").contains(" ")).groupBy("element").agg(F.count("*").alias("n")).filter("n >= 2")
    return contexts.token_regimes(phrases, _signatures(spark, d), names).select("element", *[r6(c).alias(c) for c in names])


CONTEXTS = f"""{TOKENS}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, position) - 1 AS span_id FROM tokened), said AS (SELECT n.span_id, s.span AS text, n.tokens FROM numbered n JOIN spans s ON n.doc_id = s.doc_id AND n.position = s.position),
said_words AS (SELECT w, {STEM} AS stem FROM (SELECT DISTINCT unnest(tokens) AS w FROM tokened)), members AS (SELECT stem AS compound, w AS element FROM said_words WHERE stem IN (SELECT stem FROM said_words GROUP BY stem HAVING count(*) > 1 ORDER BY count(*) DESC, stem LIMIT 20)),
hits AS (SELECT m.compound, e.span_id, count(*) AS overlap FROM (SELECT span_id, unnest(list_distinct(tokens)) AS element FROM said) e JOIN members m ON e.element = m.element GROUP BY ALL),
whole AS (SELECT h.*, s.text FROM hits h JOIN said s ON h.span_id = s.span_id)"""


def _contexts(spark, d):
    """The spans and words around compounds of the corpus: words of one stem."""
    docs = at(spark, d, "documents")
    made = cut(terms.segmented(docs, whole=True))
    ids = ranked(made.select("doc_id", "position"), F.col("doc_id"), F.col("position")).withColumn("span_id", F.col("place") - 1)
    spans = made.join(ids, ["doc_id", "position"]).select("span_id", F.col("span").alias("text"), F.filter(F.split("tokens", " "), lambda t: t != "").alias("elements"))
    spans = cut(spans)
    words = cut(spans.select(F.explode("elements").alias("element")).distinct().withColumn("compound", text.root_key(F.col("element"))))
    # The twenty stems with the most words.
    top = words.groupBy("compound").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "compound").limit(20)
    # A stem has a word for each suffix at most.
    members = cut(words.join(F.broadcast(top), "compound").select("compound", "element"))
    return contexts.supporting_spans(F.broadcast(members), spans)


@query(f"WITH {CONTEXTS} SELECT compound, row_number() OVER (PARTITION BY compound ORDER BY overlap DESC, text DESC, span_id) AS place, overlap, span_id FROM whole QUALIFY place <= 5")
def compound_spans(spark, d):
    return _contexts(spark, d)[0]


@query(f"WITH {CONTEXTS}, w AS (SELECT compound, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM whole), c AS (SELECT compound, word, count(*) AS n FROM w GROUP BY ALL) SELECT compound, word, n, row_number() OVER (PARTITION BY compound ORDER BY n DESC, word) AS place FROM c QUALIFY place <= 15")
def compound_keywords(spark, d):
    return contexts.top_words(_contexts(spark, d)[1])


@query(f"WITH {STABLE}, s AS (SELECT element, round(coherence / (1 + greatest(entropy, 0.0)), 9) AS st FROM coh), a AS (SELECT element, round(st, 6) AS stability, 'stable' AS side FROM s ORDER BY st DESC, element LIMIT 10), b AS (SELECT element, round(st, 6) AS stability, 'unstable' AS side FROM s ORDER BY st, element LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b")
def most_and_least_stable(spark, d):
    s = cut(scores.with_stability(_stable(spark, d)).select("element", F.round("stability", 9).alias("st")))
    end = lambda order, side: s.orderBy(order, "element").limit(10).select("element", r6("st").alias("stability"), F.lit(side).alias("side"))
    return end(F.desc("st"), "stable").union(end(F.asc("st"), "unstable"))


@query("WITH t AS (" + ORACLES["core_score_rank"] + ") SELECT * FROM t WHERE contains(element, 'th')")
def ranked_then_searched(spark, d):
    """The search looks at the ranking's first elements only."""
    return core_score_rank(spark, d).filter(F.col("element").contains("th"))


# ---------------------------------------------------------------- timeline
KIND = "['disinfo', 'Mis-', 'primary', 'corrective', 'INFO', '', 'other'][doc_id % 7 + 1]"


@query(f"""WITH r AS (SELECT {KIND} AS raw FROM documents) SELECT CASE WHEN lower(raw) LIKE 'dis%' THEN 'Disinformation' WHEN lower(raw) LIKE 'mis%' THEN 'Misinformation' WHEN lower(raw) LIKE 'pri%' THEN 'Information (Primary source)' WHEN lower(raw) LIKE 'cor%' THEN 'Information (Corrective)' ELSE 'Information' END AS event_class,
CASE WHEN lower(raw) LIKE 'dis%' THEN 'Disinformation' WHEN lower(raw) LIKE 'mis%' THEN 'Misinformation' WHEN lower(raw) LIKE 'pri%' OR lower(raw) LIKE 'cor%' OR lower(raw) LIKE 'info%' THEN 'Information' ELSE 'Unclassified' END AS timeline_class, count(*) AS n FROM r GROUP BY ALL""")
def classifications(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("disinfo", "Mis-", "primary", "corrective", "INFO", "", "other"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return at(spark, d, "documents").select(scores.event_class(raw).alias("event_class"), scores.timeline_class(raw).alias("timeline_class")).groupBy("event_class", "timeline_class").agg(F.count("*").alias("n"))


@query(f"WITH {BACKBONE} SELECT CASE WHEN source % 10 = 0 THEN 'given' WHEN target % 3 = 0 THEN 'compound' WHEN scaled_weight < 0.15 THEN 'semantic' ELSE 'cooccur' END AS kind, count(*) AS n FROM scored GROUP BY 1")
def edge_kinds(spark, d):
    kind = scores.edge_kind(F.when(F.col("source") % 10 == 0, "given"), F.when(F.col("target") % 3 == 0, F.col("target")), F.col("scaled_weight"))
    return _scored(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id AS step, max(epoch_ms(ts)) FILTER (event_type = 'view') AS a, max(epoch_ms(ts)) FILTER (event_type IN ('purchase', 'error')) AS b FROM events GROUP BY 1), i AS (SELECT step, a, CASE WHEN b IS NULL THEN a + 1 ELSE b END AS b FROM s WHERE a IS NOT NULL), g AS (SELECT min(a) AS lo, max(b) AS hi FROM i)
SELECT step, round((a - lo) / (hi - lo)::DOUBLE, 6) AS position, round((b - a) / (hi - lo)::DOUBLE, 6) AS width FROM i, g""")
def step_log_intervals(spark, d):
    return timeline.step_intervals(at(spark, d, "events"), "user_id", ["view"], ["purchase", "error"]).select(F.col("user_id").alias("step"), *[r6(c).alias(c) for c in ("position", "width")])


@query(f"WITH {TOKENS}, e AS (SELECT DISTINCT doc_id, unnest(tokens) AS element FROM tokened) SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, element, count(*) AS n FROM events JOIN e ON user_id = doc_id GROUP BY ALL HAVING count(*) >= 3")
def timeline_elements(spark, d):
    seen = at(spark, d, "events").groupBy(F.col("user_id").alias("doc_id"), F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("k"))
    held = terms.elements(at(spark, d, "documents"), phrases=False).select("doc_id", "element").distinct()
    return seen.join(held, "doc_id").groupBy("day", "element").agg(F.sum("k").alias("n")).filter("n >= 3")


@query("WITH e AS (SELECT substr(CAST(ts AS VARCHAR), 6, 5) AS day, count(*) AS a FROM events GROUP BY 1), o AS (SELECT substr(CAST(o_orderdate AS VARCHAR), 6, 5) AS day, count(*) AS b, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT e.day, a AS n_events, b AS n_orders, total FROM e JOIN o ON e.day = o.day")
def timeline_dates(spark, d):
    day = lambda c: F.date_format(c, "MM-dd").alias("day")
    e = at(spark, d, "events").groupBy(day("ts")).agg(F.count("*").alias("n_events"))
    return e.join(at(spark, d, "orders").groupBy(day("o_orderdate")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")), "day")


NUMBER = r"regexp_extract(url, '/(\d+)(?:[?#].*)?$', 1)"


@query(f"WITH p AS (SELECT page_id, TRY_CAST({NUMBER} AS BIGINT) AS doc FROM pages) SELECT 'page' AS kind, p.page_id AS id, d.source FROM p LEFT JOIN documents d ON p.doc = d.doc_id UNION ALL SELECT 'document', d.doc_id, d.source FROM documents d WHERE d.doc_id NOT IN (SELECT doc FROM p WHERE doc IS NOT NULL)")
def timeline_with_documents(spark, d):
    """Pages with the document that their address names, and the documents that no page names."""
    docs = at(spark, d, "documents").select("doc_id", "source")
    pages = at(spark, d, "pages").select("page_id", F.expr("try_cast(regexp_extract(url, '/(\\\\d+)(?:[?#].*)?$', 1) as bigint)").alias("doc_id"))
    linked = pages.join(docs, "doc_id", "left").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "source")
    return linked.unionByName(docs.join(pages, "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "source"))


@query("SELECT n_name AS compound, count(*) AS n_events, max(ts) AS last FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def compound_events(spark, d):
    """Events of the members of each compound up to a date."""
    members = at(spark, d, "customer").join(at(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("compound"))
    return timeline.until(at(spark, d, "events"), members, "2024-01-10 00:00:00")


@query("WITH t AS (" + ORACLES["document_word_freq"] + "), f AS (" + ORACLES["element_frequencies"] + ") SELECT t.doc_id, t.word, t.n, f.collection_freq, f.span_freq FROM t LEFT JOIN f ON t.word = f.element")
def word_rows(spark, d):
    docs = at(spark, d, "documents")
    freq = terms.frequencies(terms.tokenised(docs)).withColumnRenamed("element", "word")
    return terms.top_words(docs).select("doc_id", "word", "n").join(freq, "word", "left").select("doc_id", "word", "n", "collection_freq", "span_freq")


@query("SELECT doc_id, n_chars, place FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents)")
def document_ranks(spark, d):
    return ranked(at(spark, d, "documents").select("doc_id", "n_chars"), F.desc("n_chars"), F.col("doc_id"))


# ---------------------------------------------------------------- vectors and graph measures
@query()
def condense_metrics(spark, d):
    units = cut(vectors.normalised(at(spark, d, "embeddings")))
    return vectors.cluster_metrics(units, vectors.condense(units)).select("leader", "size", *r6s("mean_similarity", "entropy_spread"), "degenerate", "root")


@query()
def lsa_elements(spark, d):
    """Coherence of each element in the space of the leading singular vectors of the spans' weights."""
    weighted = terms.weights(at(spark, d, "documents"))
    spans, _ = vectors.lsa(weighted)
    return vectors.element_vectors(weighted, spans).select(F.col("label").alias("element"), "n", r6("coherence").alias("coherence"))


@query()
def lsa_fusion(spark, d):
    """Spans linked to elements: both as vectors of the same space, the adaptive threshold by the span's entropy."""
    listed, words = terms.span_weights(at(spark, d, "documents"))
    # Ids are given as the table is written, so they stay.
    spans = cut(vectors.lsa_of(listed.filter("doc_id IS NOT NULL"), words.count())[0].withColumn("vec_id", F.monotonically_increasing_id()))
    found = vectors.similarity_links(spans.select("vec_id", "v"), vectors.vectors_of(spans, words.select("number", F.col("element").alias("label"))).select("label", "v"))
    return found.join(spans.select("vec_id", "doc_id", "position"), "vec_id").select("doc_id", "position", "element", *[r6(c).alias(c) for c in ("similarity", "threshold")])


@query()
def betweenness(spark, d):
    return graph.betweenness(_edges(spark, d)).select("node", F.round("betweenness", 9).alias("betweenness"))


@query()
def top_spectral_gap(spark, d):
    """Of the graph of the 200 nodes with the most edges."""
    edges = _edges(spark, d)
    few = graph.induced(edges, graph.degree(edges).orderBy(F.desc("degree"), "node").limit(200))
    return spark.createDataFrame([(spectra.spectral_gap(few),)], "gap double")


@query()
def spectral_gap(spark, d):
    """Of the whole graph."""
    return spark.createDataFrame([(spectra.spectral_gap(_edges(spark, d)),)], "gap double")


@query(f"""WITH RECURSIVE {GROUPS}, walk(component, start, node, far) USING KEY (component, start, node) AS (SELECT component, node, node, 0 FROM grp UNION SELECT w.component, w.start, s.other, w.far + 1 FROM walk w JOIN esides s ON w.node = s.node WHERE NOT EXISTS (SELECT 1 FROM recurring.walk o WHERE o.component = w.component AND o.start = w.start AND o.node = s.other))
SELECT component AS "group", max(far) AS diameter FROM walk GROUP BY component""")
def component_diameters(spark, d):
    edges = _edges(spark, d)
    return graph.group_diameters(edges, graph.components(edges).withColumnRenamed("component", "group"))


# ---------------------------------------------------------------- a run
@query(f"WITH {STATS}, r AS (SELECT count(*) AS n FROM tokened) SELECT 'elements' AS table_name, (SELECT count(*) FROM stats) AS n_rows UNION ALL SELECT 'stability', (SELECT count(*) FROM stats) UNION ALL SELECT 'tokens', (SELECT n FROM r) UNION ALL SELECT 'weights', (SELECT count(*) FROM weights)")
def corpus_run(spark, d):
    """The first stages of a run over the documents: how many rows each table has."""
    made = runs.run_stages(runs.Run(spark, at(spark, d, "documents")), only=("spans", "elements", "stability")).tables
    counts = [(name, df.count()) for name, df in made.items()]
    return spark.createDataFrame(counts, "table_name string, n_rows long")


# ---------------------------------------------------------------- descriptions, snapshots, layout, report
@query(f"""WITH {SIGN}, top AS (SELECT element FROM (SELECT unnest(tokens) AS element FROM tokened) GROUP BY element ORDER BY count(*) DESC, element LIMIT 500),
u AS (SELECT doc_id, position, unnest(list_distinct(tokens)) AS element FROM tokened), ex AS (SELECT element, least(3, count(*)) AS n_examples FROM u SEMI JOIN top ON u.element = top.element GROUP BY element)
SELECT s.element, CASE WHEN length(s.element) <= 24 THEN s.element ELSE regexp_replace(substr(s.element, 1, 21), ' [^ ]*$', '') || '...' END AS label, support, dominant_label, coalesce(n_examples, 0) AS n_examples, round(a, 6) AS p_information FROM signs s LEFT JOIN ex ON s.element = ex.element""")
def element_descriptions(spark, d):
    """Label, regime and examples of each element as one JSON record, written and read back."""
    tokens = cut(terms.tokenised(at(spark, d, "documents"), phrases=False))
    targets = tokens.select(F.explode("elements").alias("element")).groupBy("element").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element").limit(500).select("element")
    shown = contexts.examples(tokens, targets).groupBy("element").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "position"))).alias("examples"))
    path = new_path(spark)
    record = F.struct("support", "dominant_label", r6("p_information").alias("p_information"))
    sinks.write_records(_signatures(spark, d).join(shown, "element", "left").select("element", text.short_label(F.col("element")).alias("label"), record.alias("regime"), F.coalesce("examples", F.array().cast("array<struct<place:int,doc_id:bigint,position:int>>")).alias("examples")), path)
    back = sinks.read_records(spark, path, "element string, label string, regime struct<support: long, dominant_label: string, p_information: double>, examples array<struct<place: int, doc_id: long, position: int>>")
    return back.select("element", "label", "regime.support", "regime.dominant_label", F.size("examples").alias("n_examples"), "regime.p_information")


@query(f"WITH {SIGN} SELECT count(*) AS n, round(avg(a), 6) AS info, round(avg(b), 6) AS misinfo, round(avg(c), 6) AS disinfo, round(avg(a) / (avg(a) + avg(b) + avg(c)), 6) AS info_share FROM signs")
def regime_means(spark, d):
    a, b, c = (F.avg(f"p_{x}") for x in scores.LABELS[:3])
    return _signatures(spark, d).agg(F.count("*").alias("n"), r6(a).alias("info"), r6(b).alias("misinfo"), r6(c).alias("disinfo"), r6(a / (a + b + c)).alias("info_share"))


@query(f"WITH {SIDES}, n AS (SELECT node FROM edeg ORDER BY degree DESC, node LIMIT 100) SELECT source, target, weight FROM whole WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)")
def snapshot_through_table(spark, d):
    """The graph of the 100 nodes with the most edges as a stored snapshot, read back."""
    edges, path = _edges(spark, d), new_path(spark)
    graph.induced(edges, graph.degree(edges).orderBy(F.desc("degree"), "node").limit(100)).select("source", "target", "weight").write.parquet(path)
    return spark.read.parquet(path)


@query(f"""WITH {SIDES}, g AS (SELECT node, degree, p_brand AS grp FROM edeg JOIN part ON node = p_partkey), r AS (SELECT *, dense_rank() OVER (ORDER BY grp) - 1 AS sector, row_number() OVER (PARTITION BY grp ORDER BY degree DESC, node) - 1 AS place, count(*) OVER (PARTITION BY grp) AS size FROM g), k AS (SELECT max(sector) + 1 AS sectors FROM r)
SELECT node, round((1.0 + place) / size * cos(2 * pi() * (sector + (place + 0.5) / size) / sectors), 6) + 0.0 AS x, round((1.0 + place) / size * sin(2 * pi() * (sector + (place + 0.5) / size) / sectors), 6) + 0.0 AS y FROM r, k""")
def radial_layout(spark, d):
    groups = at(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("group"))
    return styling.radial(graph.degree(_edges(spark, d)).join(groups, "node")).select("node", *r6s("x", "y"))


@query("SELECT unnest(['documents: ' || (SELECT count(*) FROM documents), 'characters: ' || (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents), 'sources: ' || (SELECT count(DISTINCT source) FROM documents), 'labelled: ' || (SELECT count(*) FROM labels)]) AS line")
def report_text(spark, d):
    """The report's lines."""
    docs = at(spark, d, "documents")
    facts = docs.agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.countDistinct("source").alias("sources")).crossJoin(at(spark, d, "labels").agg(F.count("*").alias("labelled")))
    return reports.lines(facts)


# ---------------------------------------------------------------- tokenizers, SQL functions, results, forces
OTHER = re.sub(r"(?s)list_filter\(list_transform\(regexp_extract_all\(span, .*?\) AS tokens", lambda _: r"regexp_extract_all(lower(span), '[\p{L}\p{N}_-]+') AS tokens", STATS)


@query(f"WITH {OTHER} SELECT element, collection_freq, span_freq, round(tfidf, 6) AS tfidf, round(entropy, 6) + 0.0 AS entropy FROM stats")
def tfidf_other_tokens(spark, d):
    """The whole chain of statistics with another tokenizer: runs of letters, digits, _ and - of any script."""
    return terms.statistics(at(spark, d, "documents"), tokens=text.word_characters).select("element", "collection_freq", "span_freq", *r6s("tfidf", "entropy"))


@query(f"WITH {FREQ} SELECT element, collection_freq, span_freq, round(-(collection_freq / (collection_freq + span_freq)) * ln(collection_freq / (collection_freq + span_freq)) - (span_freq / (collection_freq + span_freq)) * ln(span_freq / (collection_freq + span_freq)), 6) AS entropy FROM freq WHERE span_freq >= 3")
def sql_functions(spark, d):
    """A query in SQL text by the functions of the session."""
    session.register(spark, at(spark, d, "documents").select("doc_id", "text"))
    return spark.sql("SELECT element, collection_freq, span_freq, round(corpus_entropy(array(CAST(collection_freq AS DOUBLE), CAST(span_freq AS DOUBLE))), 6) AS entropy FROM corpus_frequencies(3)")


@query(f"WITH {FREQ}, n AS (SELECT count(*) FILTER (span_freq >= 2) AS two, count(*) FILTER (span_freq >= 3) AS three FROM freq) SELECT 'first' AS step, true AS made, two AS n_rows FROM n UNION ALL SELECT 'again', false, two FROM n UNION ALL SELECT 'changed', true, three FROM n UNION ALL SELECT 'as at first', false, two FROM n")
def rehydrated_elements(spark, d):
    """Frequencies as stored results: read again for the same files and parameters, made for others."""
    docs, kept, rows = f"{d}/documents.parquet", Results(spark, new_path(spark)), []
    for step, least in (("first", 2), ("again", 2), ("changed", 3), ("as at first", 2)):
        found, made = kept.table("frequencies", [docs], {"least": least}, lambda least=least: terms.frequencies(terms.tokenised(spark.read.parquet(docs))).filter(F.col("span_freq") >= least))
        rows.append((step, made, found.count()))
    return spark.createDataFrame(rows, "step string, made boolean, n_rows long")


FORCES = f"""{SIDES}, pos AS (SELECT p_partkey AS id, (p_partkey * 7919) % 10007 / 10007.0::DOUBLE AS x, (p_partkey * 104729) % 10009 / 10009.0::DOUBLE AS y FROM part),
box AS (SELECT min(x) AS lx, min(y) AS ly, greatest(max(x) - min(x), max(y) - min(y)) * (1 + 1e-9::DOUBLE) AS side, CAST(greatest(2, ceil(ln(count(*)) / ln(4)) + 1) AS INT) AS depth FROM pos),
fine AS (SELECT id, x, y, CAST(floor((x - lx) / side * 2 ** depth) AS BIGINT) AS cx, CAST(floor((y - ly) / side * 2 ** depth) AS BIGINT) AS cy, depth FROM pos, box),
lev AS (SELECT id, x, y, CAST(l AS INT) AS l, cx >> CAST(depth - l AS BIGINT) AS cx, cy >> CAST(depth - l AS BIGINT) AS cy, depth FROM fine, range(2, 30) r(l) WHERE l <= depth),
cells AS (SELECT l, cx, cy, count(*) AS m, avg(x) AS gx, avg(y) AS gy FROM lev GROUP BY ALL),
acts AS (SELECT n.id, n.x - gx AS dx, n.y - gy AS dy, m FROM lev n JOIN cells c ON n.l = c.l AND abs((n.cx >> 1) - (c.cx >> 1)) <= 1 AND abs((n.cy >> 1) - (c.cy >> 1)) <= 1 AND greatest(abs(n.cx - c.cx), abs(n.cy - c.cy)) > 1
  UNION ALL SELECT a.id, a.x - b.x, a.y - b.y, 1 FROM fine a JOIN fine b ON a.id <> b.id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 JOIN cells c ON c.l = b.depth AND c.cx = b.cx AND c.cy = b.cy AND c.m <= 32
  UNION ALL SELECT a.id, CASE WHEN a.cx = c.cx AND a.cy = c.cy THEN a.x - (gx * m - a.x) / (m - 1) ELSE a.x - gx END, CASE WHEN a.cx = c.cx AND a.cy = c.cy THEN a.y - (gy * m - a.y) / (m - 1) ELSE a.y - gy END, CASE WHEN a.cx = c.cx AND a.cy = c.cy THEN m - 1 ELSE m END FROM fine a JOIN cells c ON c.l = a.depth AND c.m > 32 AND abs(a.cx - c.cx) <= 1 AND abs(a.cy - c.cy) <= 1),
push AS (SELECT id, sum(m * dx / (dx * dx + dy * dy + 1e-12)) AS fx, sum(m * dy / (dx * dx + dy * dy + 1e-12)) AS fy FROM acts GROUP BY id),
pull AS (SELECT s.node AS id, sum(weight * sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) * (b.x - a.x)) AS ax, sum(weight * sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) * (b.y - a.y)) AS ay FROM esides s JOIN pos a ON a.id = s.node JOIN pos b ON b.id = s.other GROUP BY s.node)"""


@query(f"WITH {FORCES} SELECT id, round(coalesce(fx, 0), 4) + 0.0 AS fx, round(coalesce(fy, 0), 4) + 0.0 AS fy, round(coalesce(ax, 0), 6) + 0.0 AS ax, round(coalesce(ay, 0), 6) + 0.0 AS ay FROM pos LEFT JOIN push USING (id) LEFT JOIN pull USING (id)")
def layout_forces(spark, d):
    """The forces of one step of a spring layout over all nodes and edges: repulsion through the pyramid, pull along edges."""
    key = F.col("p_partkey")
    nodes = cut(at(spark, d, "part").select(key.alias("id"), (key * 7919 % 10007 / 10007.0).alias("x"), (key * 104729 % 10009 / 10009.0).alias("y")))
    pull = layout.attraction(nodes, _edges(spark, d)).select("id", F.col("fx").alias("ax"), F.col("fy").alias("ay"))
    both = layout.repulsion(nodes).join(pull, "id", "left").fillna(0.0)
    return both.select("id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("fx", "fy")], *r6s("ax", "ay"))


@query(f"WITH {ROOTS}, m AS (SELECT root_id, count(*) AS n_members, min(element) AS first_member FROM roots r JOIN keyed k ON r.root_key = k.root_key GROUP BY root_id) SELECT k.element, r.root_id, r.root_key, r.representative, r.size, k.collection_freq, n_members, first_member FROM keyed k JOIN roots r ON k.root_key = r.root_key JOIN m ON r.root_id = m.root_id")
def roots_through_files(spark, d):
    """Elements with their roots as CSV and clusters with their members as records, written and read back together."""
    path, freqs = new_path(spark), cut(_freq(spark, d))
    table, clusters = terms.root_tables(freqs)
    sinks.write_csv(table, f"{path}/element_roots", "root_id", "element")
    sinks.write_records(clusters, f"{path}/element_clusters")
    rows = spark.read.schema(table.schema).option("header", "true").csv(f"{path}/element_roots")
    back = sinks.read_records(spark, f"{path}/element_clusters", "root_id string, members array<string>")
    return rows.join(back, "root_id").select("element", "root_id", "root_key", "representative", "size", "collection_freq", F.size("members").alias("n_members"), F.element_at("members", 1).alias("first_member"))
