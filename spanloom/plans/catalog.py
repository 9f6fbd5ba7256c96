"""All queries of the engine by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import scores, text
from spanloom.operators import community, graph, language, reports, service, simulation, terms, timeline, vectors
from spanloom.plans.tables import cut, ranked
from spanloom.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def at(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- text
STRIP = r"regexp_replace({0}, '^[\t-\r \x85\xA0]+|[\t-\r \x85\xA0]+$', '', 'g')"
SQUEEZE = STRIP.format(r"regexp_replace(regexp_replace(coalesce({0}, ''), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g')")
SPANS = f"""
lines AS (
  SELECT doc_id, list_filter(list_transform(string_split({SQUEEZE.format("text")}, chr(10)), lambda x: {STRIP.format("x")}),
    lambda x: CASE WHEN length(x) < 20 THEN length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) >= 10
      ELSE length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / length(x) >= 0.3 END) AS spans
  FROM documents),
spans AS (SELECT doc_id, unnest(spans) AS span, generate_subscripts(spans, 1) - 1 AS position FROM lines)"""
TOKENS = f"""{SPANS},
tokened AS (
  SELECT doc_id, position, list_filter(list_transform(regexp_extract_all(span, '[A-Za-z][A-Za-z-]{{2,}}'),
    lambda x: regexp_replace(lower(x), '[^a-z]+', '', 'g')),
    lambda t: length(t) > 2 AND NOT regexp_matches(t, '^(label|fig|tab|table|eq|chap|sec|subsec|ref|cite)') AND regexp_matches(t, '[aeiou]')) AS tokens
  FROM spans)"""
ELEMENTS = f"""{TOKENS},
elements AS (
  SELECT doc_id, position, unnest(tokens) AS element FROM tokened
  UNION ALL
  SELECT doc_id, position, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS element FROM tokened WHERE len(tokens) > 1)"""
FREQ = f"""{ELEMENTS},
per_span AS (SELECT element, doc_id, position, count(*) AS tf FROM elements GROUP BY ALL),
freq AS (SELECT element, CAST(sum(tf) AS BIGINT) AS collection_freq, count(*) AS span_freq FROM per_span GROUP BY element)"""
WEIGHTS = f"""{FREQ},
vocab AS (SELECT * FROM freq WHERE span_freq >= 2 ORDER BY collection_freq DESC, element LIMIT 5000),
idfs AS (SELECT element, ln((1.0 + (SELECT count(*) FROM spans)) / (1.0 + span_freq)) + 1.0 AS idf FROM vocab),
raw AS (SELECT p.doc_id, p.position, p.element, p.tf, i.idf, p.tf * i.idf AS x FROM per_span p JOIN idfs i ON p.element = i.element),
weights AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, position)) AS weight FROM raw)"""


@query(f"WITH {SPANS} SELECT doc_id, position, length(span) AS n_chars, md5(span) AS digest FROM spans")
def span_segmentation(spark, d):
    return terms.spans(at(spark, d, "documents")).select("doc_id", "position", F.length("span").alias("n_chars"), F.md5(F.col("span").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({SQUEEZE.format('text')}) AS digest FROM documents")
def clean_text(spark, d):
    return at(spark, d, "documents").select("doc_id", F.md5(text.squeeze(F.col("text")).cast("binary")).alias("digest"))


@query("WITH s AS (SELECT page_id, " + SQUEEZE.format("regexp_replace(html, '<[^>]+>', ' ', 'g')") + " AS t FROM pages) SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM s")
def html_strip(spark, d):
    t = text.strip_html(F.col("html"))
    return at(spark, d, "pages").select("page_id", F.length(t).alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


LATEX_SQL = "text"
for _p in (r"(?s)\\begin\{[^}]+\}.*?\\end\{[^}]+\}", r"\$[^$]*\$", r"(?s)\\\[.*?\\\]", r"\\[a-zA-Z]+(\*?)\s*(\[[^\]]*\])?(\{[^}]*\})?", r"(?m)^[-=]{3,}\s*$"):
    LATEX_SQL = f"regexp_replace({LATEX_SQL}, '{_p}', ' ', 'g')"


@query("WITH s AS (SELECT doc_id, " + SQUEEZE.replace("{0}", "@").replace("{{2,}}", "{2,}").replace("@", LATEX_SQL) + " AS t FROM documents) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM s")
def latex_strip(spark, d):
    t = text.strip_latex(F.col("text"))
    return at(spark, d, "documents").select("doc_id", F.length(t).alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query(f"WITH {TOKENS} SELECT t AS token, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM tokened) u GROUP BY t")
def token_normalise(spark, d):
    return terms.elements(at(spark, d, "documents"), phrases=False).groupBy(F.col("element").alias("token")).agg(F.count("*").alias("n"))


@query(f"WITH {ELEMENTS} SELECT element AS phrase, count(*) AS n FROM elements WHERE contains(element, ' ') GROUP BY element HAVING count(*) >= 2")
def bigram_phrases(spark, d):
    return terms.elements(at(spark, d, "documents")).filter(F.col("element").contains(" ")).groupBy(F.col("element").alias("phrase")).agg(F.count("*").alias("n")).filter("n >= 2")


ESTIMATE = r"len(list_filter(regexp_split_to_array(substr(text, 1, 8192), '[ \t-\r]+'), lambda x: x <> ''))"
EST = f"greatest(CAST(floor({ESTIMATE} / greatest(strlen(substr(text, 1, 8192)), 1) * strlen(text)) AS BIGINT), {ESTIMATE})"


@query(f"SELECT source, lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum({EST}) AS BIGINT) AS est_tokens, round(avg({EST}), 6) AS mean_tokens FROM documents GROUP BY source, lang")
def corpus_profile(spark, d):
    est = text.token_estimate(F.col("text"))
    return at(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.sum(est).alias("est_tokens"), r6(F.avg(est)).alias("mean_tokens"))


@query(f"SELECT doc_id, {EST} AS est_tokens FROM documents")
def token_estimates(spark, d):
    return at(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("est_tokens"))


BASE = r"regexp_extract(url, '([^/]*)$', 1)"


@query(rf"SELECT regexp_replace({BASE}, '-\d+(\.[^.]+)$', '\1') AS slug, count(*) AS n_files, CAST(sum(length(html)) AS BIGINT) AS n_chars FROM pages GROUP BY 1")
def slug_stats(spark, d):
    return at(spark, d, "pages").groupBy(text.slug(F.col("url")).alias("slug")).agg(F.count("*").alias("n_files"), F.sum(F.length("html")).alias("n_chars"))


@query(rf"""SELECT CASE lower(regexp_extract({BASE}, '(\.[^.]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.tex' THEN 'latex' WHEN '.py' THEN 'python' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' ELSE 'text' END AS kind, count(*) AS n FROM pages GROUP BY 1""")
def file_kind(spark, d):
    return at(spark, d, "pages").groupBy(text.file_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query(rf"""SELECT CASE WHEN regexp_matches(lower({BASE}), 'paper1|paper2|k-it|epistemic|methodology|theory|introduction') THEN 'theory' WHEN regexp_matches(lower({BASE}), 'connor|reed|case|misinfo|social|covid') THEN 'case' ELSE 'other' END AS class, count(*) AS n FROM pages GROUP BY 1""")
def file_class(spark, d):
    return at(spark, d, "pages").groupBy(text.file_class(F.col("url")).alias("class")).agg(F.count("*").alias("n"))


STEM = """CASE WHEN length(w) <= 3 THEN w WHEN length(w) > 4 AND w LIKE '%ies' AND NOT w LIKE '%eies' THEN substr(w, 1, length(w) - 3) || 'y'
  WHEN length(w) > 5 AND w LIKE '%ing' THEN substr(w, 1, length(w) - 3) WHEN length(w) > 5 AND w LIKE '%ers' THEN substr(w, 1, length(w) - 3)
  WHEN length(w) > 4 AND w LIKE '%er' THEN substr(w, 1, length(w) - 2) WHEN length(w) > 4 AND w LIKE '%ed' THEN substr(w, 1, length(w) - 2)
  WHEN w LIKE '%es' AND NOT w LIKE '%ses' THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%s' AND NOT w LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END"""
ROOTS = f"""{FREQ},
keyed AS (SELECT *, array_to_string(list_transform(string_split(element, ' '), lambda w: {STEM}), ' ') AS root_key FROM freq WHERE span_freq >= 2),
grouped AS (SELECT root_key, count(*) AS size, CAST(sum(collection_freq) AS BIGINT) AS total_freq FROM keyed GROUP BY root_key),
best AS (SELECT root_key, element AS representative FROM keyed QUALIFY row_number() OVER (PARTITION BY root_key ORDER BY collection_freq DESC, element) = 1),
roots AS (SELECT printf('R%04d', row_number() OVER (ORDER BY size DESC, g.root_key)) AS root_id, g.root_key, size, representative, total_freq FROM grouped g JOIN best b ON g.root_key = b.root_key)"""


def _freq(spark, d):
    return terms.frequencies(terms.tokenised(at(spark, d, "documents"))).filter("span_freq >= 2")


@query(f"WITH {ROOTS} SELECT * FROM roots")
def root_clusters(spark, d):
    return terms.roots(_freq(spark, d)).select("root_id", "root_key", "size", "representative", "total_freq")


@query(f"WITH {ROOTS} SELECT count(*) AS n_clusters, count(*) FILTER (size = 1) AS n_singletons, round(avg(size), 6) AS mean_size, max(size) AS max_size, round(median(size), 6) AS median_size FROM roots")
def root_cluster_stats(spark, d):
    return terms.roots(_freq(spark, d)).agg(F.count("*").alias("n_clusters"), F.count(F.when(F.col("size") == 1, 1)).alias("n_singletons"), r6(F.avg("size")).alias("mean_size"), F.max("size").alias("max_size"), r6(F.percentile("size", F.lit(0.5))).alias("median_size"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS place FROM c QUALIFY place <= 5""")
def document_word_freq(spark, d):
    return terms.top_words(at(spark, d, "documents"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)#\\s*(.*)$', 1)) AS n_comments FROM documents")
def code_comments(spark, d):
    return at(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("(?m)#\\s*(.*)$"), 1)).alias("n_comments"))


# ---------------------------------------------------------------- terms
@query(f"WITH {FREQ} SELECT * FROM freq")
def element_frequencies(spark, d):
    return terms.frequencies(terms.tokenised(at(spark, d, "documents")))


STATS = f"""{WEIGHTS},
stats AS (
  SELECT element, CAST(sum(tf) AS BIGINT) AS collection_freq, count(*) AS span_freq, max(idf) AS idf, sum(weight) AS tfidf, ln(sum(weight)) - sum(weight * ln(weight)) / sum(weight) AS entropy
  FROM weights GROUP BY element)"""


@query(f"WITH {STATS} SELECT element, collection_freq, span_freq, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf, round(entropy, 6) + 0.0 AS entropy FROM stats")
def tfidf_elements(spark, d):
    return terms.statistics(at(spark, d, "documents")).select("element", "collection_freq", "span_freq", r6("idf").alias("idf"), r6("tfidf").alias("tfidf"), (r6("entropy") + 0.0).alias("entropy"))


@query(f"WITH {WEIGHTS} SELECT doc_id, position, round(ln(sum(weight)) - sum(weight * ln(weight)) / sum(weight), 6) + 0.0 AS entropy FROM weights GROUP BY doc_id, position")
def span_entropy(spark, d):
    return terms.entropy_of(terms.weights(at(spark, d, "documents")), "doc_id", "position").select("doc_id", "position", (r6("entropy") + 0.0).alias("entropy"))


@query(f"WITH {FREQ} SELECT * FROM freq WHERE span_freq >= 2 ORDER BY collection_freq DESC, element LIMIT 5000")
def vocab_topk(spark, d):
    return terms.vocabulary(_freq(spark, d))


@query(f"WITH {FREQ} SELECT element, round(ln(1.0 + collection_freq) + 0.5 * ln(1.0 + span_freq), 6) AS score, row_number() OVER (ORDER BY ln(1.0 + collection_freq) + 0.5 * ln(1.0 + span_freq) DESC, element) AS place FROM freq QUALIFY place <= 120")
def core_score_rank(spark, d):
    freq = terms.frequencies(terms.tokenised(at(spark, d, "documents")))
    top = freq.withColumn("score", scores.core_score(F.col("collection_freq"), F.col("span_freq"))).orderBy(F.desc("score"), "element").limit(120)
    return top.select("element", r6("score").alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "element")).alias("place"))


STABLE = f"""{STATS}, sums AS (SELECT a.element, b.element AS other, sum(b.weight) AS s FROM weights a JOIN weights b ON a.doc_id = b.doc_id AND a.position = b.position GROUP BY 1, 2),
coh AS (SELECT t.*, CASE WHEN span_freq > 1 THEN sqrt(ss) / span_freq ELSE 0.0 END AS coherence FROM stats t JOIN (SELECT element, sum(s * s) AS ss FROM sums GROUP BY 1) l ON t.element = l.element)"""


def _stable(spark, d, made=None):
    """Element statistics with coherence: the mean cosine of their spans' vectors to the centroid. made: the tables of terms.span_weights()."""
    made = terms.span_weights(at(spark, d, "documents")) if made is None else made
    return cut(terms.statistics_of(terms.exploded(*made)).join(terms.coherence_of(*made), "element"))


@query(f"WITH {STABLE} SELECT element, round(coherence, 6) AS coherence FROM coh")
def element_coherence(spark, d):
    return _stable(spark, d).select("element", r6("coherence").alias("coherence"))


@query(f"WITH {STABLE} SELECT element, round(coherence / (1 + greatest(entropy, 0.0)), 6) AS stability FROM coh")
def stability_classic(spark, d):
    return scores.with_stability(_stable(spark, d)).select("element", r6("stability").alias("stability"))


@query(f"WITH {STABLE} SELECT element, round(coherence * exp(-greatest(entropy, 0.0)), 6) AS stability FROM coh")
def stability_entropy_weighted(spark, d):
    return scores.with_stability(_stable(spark, d), "entropy_weighted").select("element", r6("stability").alias("stability"))


@query(f"""WITH {STABLE}, b AS (SELECT min(coherence) AS cl, max(coherence) AS ch, min(entropy) AS el, max(entropy) AS eh FROM coh)
SELECT element, round((coherence - cl) / (ch - cl + 1e-12) * (1 - (entropy - el) / (eh - el + 1e-12)), 6) + 0.0 AS stability FROM coh, b""")
def stability_normalized(spark, d):
    return scores.with_stability(_stable(spark, d), "normalized").select("element", (r6("stability") + 0.0).alias("stability"))


@query(ORACLES["stability_classic"])
def stability_other_mode(spark, d):
    """A mode that is not known counts as classic."""
    return scores.with_stability(_stable(spark, d), "unheard of").select("element", r6("stability").alias("stability"))


@query(f"WITH {STABLE} SELECT element, round(least(1.0, greatest(0.0, 0.5 * (coherence + 1 - entropy))), 6) + 0.0 AS stability FROM coh")
def information_stability(spark, d):
    return _stable(spark, d).select("element", (r6(scores.information_stability(F.col("coherence"), F.col("entropy"))) + 0.0).alias("stability"))


@query(f"""WITH {STABLE}, s AS (SELECT entropy, coherence, coherence / (1 + greatest(entropy, 0.0)) AS stability FROM coh)
SELECT count(*) AS n, round(min(entropy), 6) + 0.0 AS min_entropy, round(max(entropy), 6) AS max_entropy, round(min(coherence), 6) AS min_coherence, round(max(coherence), 6) AS max_coherence, round(min(stability), 6) AS min_stability, round(max(stability), 6) AS max_stability, round(avg(stability), 6) AS mean_stability, round(median(stability), 6) AS median_stability FROM s""")
def stability_meta(spark, d):
    s = scores.with_stability(_stable(spark, d))
    ends = [(r6(f(c)) + 0.0).alias(f"{name}_{c}") for c in ("entropy", "coherence", "stability") for name, f in (("min", F.min), ("max", F.max))]
    return s.agg(F.count("*").alias("n"), *ends, r6(F.avg("stability")).alias("mean_stability"), r6(F.percentile("stability", F.lit(0.5))).alias("median_stability"))


@query(f"""WITH {STABLE}, x AS (SELECT element, entropy - coherence AS x FROM coh), b AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT element, round((x - lo) / (hi - lo + 1e-9), 6) + 0.0 AS temperature FROM x, b""")
def temperatures(spark, d):
    return scores.with_temperature(_stable(spark, d)).select("element", (r6("temperature") + 0.0).alias("temperature"))


FIELD = f"""{STABLE}, s AS (SELECT *, coherence / (1 + greatest(entropy, 0.0)) AS stability FROM coh), m AS (SELECT avg(entropy) + stddev_samp(entropy) AS bar FROM s),
d AS (SELECT w.doc_id, avg(s.stability) AS mean_stability FROM weights w JOIN s ON w.element = s.element GROUP BY 1), spread AS (SELECT stddev_samp(mean_stability) AS doc_stability_spread FROM d),
stats2 AS (SELECT avg(entropy) AS entropy_mean, median(entropy) AS entropy_median, quantile_cont(entropy, 0.9) AS entropy_p90, max(entropy) AS entropy_max, avg(CASE WHEN entropy > bar THEN 1.0 ELSE 0.0 END) AS entropy_high_fraction,
  avg(coherence) AS coherence_mean, median(coherence) AS coherence_median, avg(CASE WHEN coherence < 0.6 THEN 1.0 ELSE 0.0 END) AS coherence_low_fraction, min(coherence) AS coherence_min,
  avg(stability) AS stability_mean, median(stability) AS stability_median, avg(CASE WHEN stability < 0.25 THEN 1.0 ELSE 0.0 END) AS stability_low_fraction, quantile_cont(stability, 0.1) AS stability_p10 FROM s, m),
field AS (SELECT * FROM stats2, spread)"""
FIELD_VALUES = ("entropy_mean", "entropy_median", "entropy_p90", "entropy_max", "entropy_high_fraction", "coherence_mean", "coherence_median", "coherence_low_fraction", "coherence_min", "stability_mean", "stability_median", "stability_low_fraction", "stability_p10", "doc_stability_spread")


def _field(spark, d):
    made = terms.span_weights(at(spark, d, "documents"))
    weighted = terms.exploded(*made)
    elements = cut(scores.with_stability(_stable(spark, d, made)))
    # The vocabulary bounds what is broadcast.
    documents = weighted.join(F.broadcast(elements.select("element", "stability")), "element").groupBy("doc_id").agg(F.avg("stability").alias("mean_stability"))
    return reports.field_stats(elements, documents)


@query(f"WITH {FIELD} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in FIELD_VALUES)} FROM field")
def field_stats(spark, d):
    return _field(spark, d).select(*[r6(c).alias(c) for c in FIELD_VALUES])


@query(f"""WITH {FIELD}, r AS (SELECT list_filter([CASE WHEN entropy_high_fraction > 0.25 THEN 'entropy_high' END, CASE WHEN coherence_low_fraction > 0.20 THEN 'coherence_low' END, CASE WHEN stability_low_fraction > 0.20 THEN 'stability_low' END, CASE WHEN doc_stability_spread > 0.25 THEN 'documents_uneven' END], lambda x: x IS NOT NULL) AS found FROM field)
SELECT len(found) AS severity, array_to_string(found, ',') AS rules FROM r""")
def tuning_suggestions(spark, d):
    return reports.suggestions(_field(spark, d))


@query(f"""WITH {STABLE}, s AS (SELECT element, coherence / (1 + greatest(entropy, 0.0)) AS stability FROM coh)
SELECT w.doc_id, round(avg(s.stability), 6) AS mean_stability, count(*) AS n FROM weights w JOIN s ON w.element = s.element GROUP BY w.doc_id""")
def doc_stability(spark, d):
    made = terms.span_weights(at(spark, d, "documents"))
    weighted = terms.exploded(*made)
    # The vocabulary bounds what is broadcast.
    s = scores.with_stability(_stable(spark, d, made)).select("element", "stability")
    return weighted.join(F.broadcast(s), "element").groupBy("doc_id").agg(r6(F.avg("stability")).alias("mean_stability"), F.count("*").alias("n"))


SIGN = f"""{TOKENS},
marks AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'information' WHEN quality = 0 AND toxic = 0 THEN 'misinformation' WHEN quality = 0 THEN 'disinformation' ELSE 'ambiguous' END AS label FROM labels),
pairs AS (SELECT DISTINCT doc_id, unnest(tokens) AS element FROM tokened),
counts AS (SELECT element, count(*) FILTER (label = 'information') AS n_information, count(*) FILTER (label = 'misinformation') AS n_misinformation, count(*) FILTER (label = 'disinformation') AS n_disinformation, count(*) FILTER (label = 'ambiguous') AS n_ambiguous, count(*) AS support FROM pairs JOIN marks USING (doc_id) GROUP BY element),
p AS (SELECT *, (n_information + 1) / (support + 4.0) AS a, (n_misinformation + 1) / (support + 4.0) AS b, (n_disinformation + 1) / (support + 4.0) AS c, (n_ambiguous + 1) / (support + 4.0) AS e FROM counts),
signs AS (SELECT *, -a * log2(a) - b * log2(b) - c * log2(c) - e * log2(e) AS bits, CASE WHEN a >= greatest(b, c, e) THEN 'information' WHEN b >= greatest(c, e) THEN 'misinformation' WHEN c >= e THEN 'disinformation' ELSE 'ambiguous' END AS dominant_label FROM p)"""


def _signatures(spark, d):
    raw = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "info").when((F.col("quality") == 0) & (F.col("toxic") == 0), "misinfo").when(F.col("quality") == 0, "propaganda").otherwise("unknown")
    marks = at(spark, d, "labels").select("doc_id", raw.alias("label"))
    labelled = terms.tokenised(at(spark, d, "documents").join(marks.select("doc_id").distinct(), "doc_id", "left_semi"), phrases=False)
    pairs = labelled.select("doc_id", F.explode(F.array_distinct("elements")).alias("element")).distinct()
    return terms.signatures(pairs.join(marks, "doc_id").select("element", "label"))


@query(f"WITH {SIGN} SELECT element, n_information, n_misinformation, n_disinformation, n_ambiguous, support, round(bits, 6) AS entropy_bits, dominant_label FROM signs")
def signatures(spark, d):
    return _signatures(spark, d).select("element", *[f"n_{x}" for x in scores.LABELS], "support", r6("entropy_bits").alias("entropy_bits"), "dominant_label")


@query(f"""WITH {SIGN} SELECT element, CASE WHEN greatest(a, b, c) < 0.25 THEN 'neutral' WHEN a >= greatest(b, c) AND a > 0.5 THEN 'informationally stable' WHEN c >= greatest(a, b) AND c > 0.5 THEN 'highly polarized / disinfo-prone' WHEN b >= greatest(a, c) AND b > 0.5 THEN 'noisy / misinfo-prone' ELSE 'neutral' END AS polarity FROM signs""")
def polarity(spark, d):
    return _signatures(spark, d).select("element", scores.polarity(F.col("p_information"), F.col("p_misinformation"), F.col("p_disinformation")).alias("polarity"))


@query(f"WITH {SIGN} SELECT CASE WHEN c > b AND c > a THEN 'disinformation' WHEN b > a AND b > c THEN 'misinformation' ELSE 'information' END AS regime, count(*) AS n, round(avg(a / (a + b + c)), 6) AS info_share FROM signs GROUP BY 1")
def regime_profile(spark, d):
    a, b, c = (F.col(f"p_{x}") for x in scores.LABELS[:3])
    return _signatures(spark, d).groupBy(scores.dominant_regime(a, b, c).alias("regime")).agg(F.count("*").alias("n"), r6(F.avg(a / (a + b + c))).alias("info_share"))


@query(f"""WITH {FREQ} SELECT element, CASE WHEN length(element) <= 24 THEN element ELSE regexp_replace(substr(element, 1, 21), ' [^ ]*$', '') || '...' END AS label FROM freq WHERE span_freq >= 2""")
def label_summaries(spark, d):
    return _freq(spark, d).select("element", text.short_label(F.col("element")).alias("label"))


# ---------------------------------------------------------------- vectors
UNIT = """units AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"""
CENTRES = f"""{UNIT},
dims AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM units),
means AS (SELECT label, i, avg(x) AS x FROM dims GROUP BY label, i),
lists AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label),
centres AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM lists)"""
SPECTRAL = """greatest(0.0, least(1.0, (log2(list_sum(list_transform(v, lambda x: abs(x)))) - list_sum(list_transform(v, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE abs(x) * log2(abs(x)) END)) / list_sum(list_transform(v, lambda x: abs(x)))) / log2(len(v))))"""


def _units(spark, d):
    return vectors.normalised(at(spark, d, "embeddings"))


@query(f"WITH {UNIT} SELECT vec_id, round(list_sum(v), 6) + 0.0 AS total, round(list_max(v), 6) AS largest FROM units")
def vector_normalise(spark, d):
    return _units(spark, d).select("vec_id", (r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)) + 0.0).alias("total"), r6(F.array_max("v")).alias("largest"))


@query(f"WITH {UNIT} SELECT vec_id, round({SPECTRAL}, 6) AS entropy FROM units")
def spectral_entropy(spark, d):
    return _units(spark, d).select("vec_id", r6(scores.spectral_entropy(F.col("v"))).alias("entropy"))


@query(f"""WITH {CENTRES}, sims AS (SELECT u.vec_id, c.label AS element, list_dot_product(u.v, c.v) AS s, {SPECTRAL.replace("(v", "(u.v").replace("list_transform(v", "list_transform(u.v")} AS h FROM units u, centres c),
bars AS (SELECT *, CASE WHEN h <= 0.1 THEN 0.40 WHEN h >= 4.0 THEN 0.15 ELSE 0.15 + 0.25 * exp(-h / 2.8) END AS bar FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, c.label) <= 3)
SELECT vec_id, element, round(s, 6) AS similarity, round(bar, 6) AS threshold FROM bars WHERE s >= bar""".replace("c.label) <= 3", "element) <= 3"))
def adaptive_threshold_links(spark, d):
    u = _units(spark, d)
    return vectors.similarity_links(u, vectors.centroids(u)).select("vec_id", "element", r6("similarity").alias("similarity"), r6("threshold").alias("threshold"))


@query(f"""WITH {UNIT}, dims AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM units), s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM dims GROUP BY label, i), t AS (SELECT label, max(n) AS n, sum(s * s) AS ss FROM s GROUP BY label)
SELECT label, n, round(CASE WHEN n > 1 THEN least(1.0, greatest(0.0, (ss - n) / (n * (n - 1)))) ELSE 0.0 END, 6) + 0.0 AS coherence FROM t""")
def coherence_by_label(spark, d):
    return vectors.coherence(_units(spark, d)).select("label", "n", (r6("coherence") + 0.0).alias("coherence"))


@query()
def condense_clusters(spark, d):
    return vectors.condense(_units(spark, d))


@query()
def svd_energy(spark, d):
    return vectors.singular_values(_units(spark, d))


# ---------------------------------------------------------------- graph
PAIRS = """occ AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
edges AS (SELECT a.l_partkey AS source, b.l_partkey AS target, count(*) AS weight FROM occ a JOIN occ b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)"""
MIN_WEIGHT = 1
BACKBONE = f"""{PAIRS}, kept AS (SELECT * FROM edges WHERE weight >= {MIN_WEIGHT}),
scored AS (SELECT *, CASE WHEN max(weight) OVER () > min(weight) OVER () THEN (weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()) ELSE 1.0 END AS scaled_weight,
  ln(1.0 + weight) / ln(1.0 + max(weight) OVER ()) AS confidence,
  row_number() OVER (ORDER BY weight DESC, source, target) <= greatest(1, floor(count(*) OVER () * 0.2)) AS is_backbone FROM kept),
sides AS (SELECT source AS node, target AS other, weight, confidence FROM scored UNION ALL SELECT target, source, weight, confidence FROM scored),
degrees AS (SELECT node, count(*) AS degree, avg(weight * confidence) AS local_stability FROM sides GROUP BY node)"""
COMPONENTS = f"""{BACKBONE}, comps(node, component) USING KEY (node) AS (SELECT node, node FROM degrees UNION SELECT b.other, min(r.component) FROM comps r JOIN sides b ON r.node = b.node JOIN recurring.comps o ON o.node = b.other WHERE r.component < o.component GROUP BY b.other),
members AS (SELECT *, printf('C%04d', dense_rank() OVER (ORDER BY component)) AS compound_id FROM comps)"""


def _pairs(spark, d):
    return graph.cooccurrence(at(spark, d, "lineitem"), "l_orderkey", "l_partkey")


def _scored(spark, d):
    """The scored edges, made once."""
    return cut(graph.with_weights(cut(_pairs(spark, d).filter(F.col("weight") >= MIN_WEIGHT))))


def _members(edges):
    return cut(graph.named(graph.components(edges)))


@query(f"WITH {PAIRS} SELECT * FROM edges")
def cooccurrence_edges(spark, d):
    return _pairs(spark, d)


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS a, row_number() OVER (PARTITION BY target ORDER BY weight DESC, source) AS b FROM edges) SELECT source, target, weight FROM r WHERE a <= 30 OR b <= 30""")
def edges_topk_pruned(spark, d):
    return graph.top_per_node(_pairs(spark, d), 30)


@query(f"WITH {BACKBONE} SELECT source, target, weight, round(scaled_weight, 6) AS scaled_weight, round(confidence, 6) AS confidence, is_backbone FROM scored")
def edges_scaled_backbone(spark, d):
    return graph.with_backbone(_scored(spark, d)).select("source", "target", "weight", r6("scaled_weight").alias("scaled_weight"), r6("confidence").alias("confidence"), "is_backbone")


@query(f"WITH {BACKBONE} SELECT node, degree, round(local_stability, 6) AS local_stability FROM degrees")
def local_stability(spark, d):
    return graph.local_stability(_scored(spark, d)).select("node", "degree", r6("local_stability").alias("local_stability"))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT node, component FROM comps")
def connected_components(spark, d):
    return graph.components(_scored(spark, d))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT m.compound_id, m.node, d.degree, round(d.local_stability, 6) AS local_stability, round(p_retailprice, 2) AS price FROM members m JOIN degrees d ON m.node = d.node JOIN part ON p_partkey = m.node")
def molecules(spark, d):
    edges = _scored(spark, d)
    df = _members(edges).join(graph.local_stability(edges), "node").join(at(spark, d, "part"), F.col("node") == F.col("p_partkey"))
    return df.select("compound_id", "node", "degree", r6("local_stability").alias("local_stability"), F.round("p_retailprice", 2).alias("price"))


@query(f"""WITH RECURSIVE {COMPONENTS}, n AS (SELECT compound_id, count(*) AS n_elements FROM members GROUP BY 1), e AS (SELECT m.compound_id, count(*) AS n_bonds, avg(weight) AS stability FROM scored s JOIN members m ON s.source = m.node GROUP BY 1)
SELECT n.compound_id, n_elements, n_bonds, round(stability, 6) AS stability FROM n LEFT JOIN e ON n.compound_id = e.compound_id""")
def compounds(spark, d):
    edges = _scored(spark, d)
    return graph.compounds(edges, _members(edges)).select("compound_id", "n_elements", "n_bonds", r6("stability").alias("stability"))


@query(f"""WITH RECURSIVE {COMPONENTS} SELECT m.compound_id, count(*) AS n_elements, round(avg(d.local_stability), 6) AS mean_stability, round(var_pop(d.local_stability), 6) + 0.0 AS stability_variance FROM members m JOIN degrees d ON m.node = d.node GROUP BY 1""")
def compound_stability(spark, d):
    edges = _scored(spark, d)
    df = _members(edges).join(graph.local_stability(edges), "node")
    return df.groupBy("compound_id").agg(F.count("*").alias("n_elements"), r6(F.avg("local_stability")).alias("mean_stability"), (r6(F.var_pop("local_stability")) + 0.0).alias("stability_variance"))


@query(f"""WITH {BACKBONE}, m AS (SELECT count(*) AS n_edges FROM scored), n AS (SELECT count(*) AS n_nodes, sum(degree * (degree - 1) / 2) AS triples FROM degrees),
t AS (SELECT count(*) AS triangles FROM scored a JOIN scored b ON a.target = b.source JOIN scored c ON c.source = a.source AND c.target = b.target)
SELECT n_nodes, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, round(2.0 * n_edges / n_nodes, 6) AS mean_degree, round(CASE WHEN triples > 0 THEN 3.0 * triangles / triples ELSE 0.0 END, 6) AS transitivity FROM m, n, t""")
def graph_stats(spark, d):
    s = graph.statistics(_scored(spark, d))
    return s.select("n_nodes", "n_edges", *[r6(c).alias(c) for c in ("density", "mean_degree", "transitivity")])


@query(f"WITH {PAIRS}, kept AS MATERIALIZED (SELECT * FROM edges) SELECT count(*) AS triangles FROM kept a JOIN kept b ON a.target = b.source JOIN kept c ON c.source = a.source AND c.target = b.target")
def triangle_count(spark, d):
    return graph.triangles(cut(_pairs(spark, d)))


IMPORTANCE = f"""{COMPONENTS}, zs AS (SELECT d.node, CASE WHEN stddev_samp(p_retailprice) OVER () > 0 THEN least(4.0, greatest(-4.0, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER ())) ELSE 0.0 END AS z, p_brand AS root FROM degrees d JOIN part ON p_partkey = d.node),
ends AS (SELECT m.node, compound_id, z, root FROM members m JOIN zs ON m.node = zs.node),
raws AS (SELECT s.source, s.target, s.weight, u.z AS uz, v.z AS vz, u.compound_id AS uc, v.compound_id AS vc, round(0.5 * scaled_weight + 0.2 * CAST(u.compound_id = v.compound_id AS INT) + 0.15 * CAST(u.root = v.root AS INT) + 0.15 * (1 - tanh(abs(u.z - v.z))), 9) AS raw FROM scored s JOIN ends u ON s.source = u.node JOIN ends v ON s.target = v.node),
imp AS (SELECT *, CASE WHEN max(raw) OVER () > min(raw) OVER () THEN (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) ELSE 1.0 END AS importance FROM raws)"""


def _important(spark, d, *carried):
    edges = _scored(spark, d)
    nodes = cut(graph.degree(edges).join(at(spark, d, "part"), F.col("node") == F.col("p_partkey")).select("node", "p_retailprice", F.col("p_brand").alias("root")))
    members = _members(edges)
    known = graph.with_sizes(members) if "size" in carried else members
    return cut(graph.with_importance(edges, known, scores.with_clipped_z(nodes, F.col("p_retailprice"), "z").select("node", "z", "root"), *carried)), members


@query(f"WITH RECURSIVE {IMPORTANCE} SELECT source, target, round(importance, 5) + 0.0 AS importance FROM imp")
def edge_importance(spark, d):
    return _important(spark, d)[0].select("source", "target", (F.round("importance", 5) + 0.0).alias("importance"))


@query(f"WITH RECURSIVE {IMPORTANCE} SELECT source, target FROM imp WHERE importance >= (SELECT quantile_cont(importance, 0.5) FROM imp)")
def prune_median(spark, d):
    return graph.prune(_important(spark, d)[0], F.col("importance"), 0.5).select("source", "target")


@query(f"WITH RECURSIVE {IMPORTANCE} SELECT source, target FROM imp WHERE importance >= (SELECT coalesce(quantile_cont(importance, 0.5) FILTER (uz > 0 AND vz > 0), quantile_cont(importance, 0.5)) FROM imp)")
def prune_thermal(spark, d):
    return graph.prune(_important(spark, d)[0], F.col("importance"), 0.5, (F.col("source_z") > 0) & (F.col("target_z") > 0)).select("source", "target")


RARE = f"""{IMPORTANCE}, sizes AS (SELECT compound_id, count(*) AS size FROM members GROUP BY 1), rare AS (SELECT source, target, round(importance / (sqrt(a.size) + sqrt(b.size)), 9) AS s FROM imp JOIN sizes a ON uc = a.compound_id JOIN sizes b ON vc = b.compound_id)"""


@query(f"WITH RECURSIVE {RARE} SELECT source, target FROM rare WHERE s >= (SELECT quantile_cont(s, 0.4) FROM rare)")
def prune_rarity(spark, d):
    # Sizes come with the ends: a join of edges by compound would put all of a large one in a task.
    edges, _ = _important(spark, d, "size")
    return graph.prune(edges, F.round(F.col("importance") / (F.sqrt("source_size") + F.sqrt("target_size")), 9), 0.4).select("source", "target")


@query(f"WITH RECURSIVE {IMPORTANCE} SELECT source, target FROM imp ORDER BY round(importance, 9) DESC, source, target LIMIT 2000")
def prune_topk(spark, d):
    return _important(spark, d)[0].orderBy(F.desc(F.round("importance", 9)), "source", "target").limit(2000).select("source", "target")


@query(f"""WITH {BACKBONE}, q AS (SELECT quantile_cont(degree, 0.25) AS a, quantile_cont(degree, 0.5) AS b, quantile_cont(degree, 0.75) AS c FROM degrees)
SELECT node, CASE WHEN degree <= a THEN 'B1' WHEN degree <= b THEN 'B2' WHEN degree <= c THEN 'B3' ELSE 'B4' END AS band FROM degrees, q""")
def quantile_bands(spark, d):
    deg = graph.degree(_scored(spark, d))
    q = F.broadcast(deg.agg(F.percentile("degree", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")))
    x = F.col("degree")
    return deg.crossJoin(q).select("node", F.when(x <= F.get("q", 0), "B1").when(x <= F.get("q", 1), "B2").when(x <= F.get("q", 2), "B3").otherwise("B4").alias("band"))


@query(f"WITH {BACKBONE} SELECT p_partkey AS node, CASE WHEN degree IS NULL THEN 'isolate' WHEN degree = 1 THEN 'leaf' ELSE 'inner' END AS kind FROM part LEFT JOIN degrees ON node = p_partkey")
def isolates_leaves(spark, d):
    df = at(spark, d, "part").join(graph.degree(_scored(spark, d)), F.col("node") == F.col("p_partkey"), "left")
    return df.select(F.col("p_partkey").alias("node"), F.when(F.col("degree").isNull(), "isolate").when(F.col("degree") == 1, "leaf").otherwise("inner").alias("kind"))


@query(f"""WITH {BACKBONE}, g AS (SELECT node, p_brand AS grp FROM degrees JOIN part ON p_partkey = node), m AS (SELECT count(*) AS m FROM scored),
inside AS (SELECT u.grp, count(*) AS k FROM scored s JOIN g u ON s.source = u.node JOIN g v ON s.target = v.node WHERE u.grp = v.grp GROUP BY 1), total AS (SELECT grp, sum(degree) AS d FROM degrees JOIN g USING (node) GROUP BY 1)
SELECT round(sum(coalesce(k, 0) / m - (d / (2.0 * m)) * (d / (2.0 * m))), 6) AS modularity FROM total LEFT JOIN inside ON total.grp = inside.grp, m""")
def modularity(spark, d):
    edges = _scored(spark, d)
    brand = graph.degree(edges).join(at(spark, d, "part"), F.col("node") == F.col("p_partkey")).select("node", F.col("p_brand").alias("group"))
    return graph.modularity(edges, brand).select(r6("modularity").alias("modularity"))


@query(f"""WITH RECURSIVE {BACKBONE}, two AS (SELECT node FROM degrees WHERE degree = 2), links AS (SELECT b.node, b.other FROM sides b WHERE b.node IN (SELECT node FROM two) AND b.other IN (SELECT node FROM two)),
walk AS (SELECT node, node AS other FROM links UNION SELECT w.node, l.other FROM walk w JOIN links l ON w.other = l.node)
SELECT node, min(other) AS chain FROM walk GROUP BY node""")
def degree2_chains(spark, d):
    return graph.chains(_scored(spark, d))


@query(f"""WITH {BACKBONE}, r AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS place, count(*) OVER () AS n FROM degrees), k AS (SELECT unnest([1, 5, 10, 25, 50, 100]) AS pct),
top AS (SELECT pct, node FROM r, k WHERE place <= greatest(1, round_even(n * pct / 100.0, 0)))
SELECT pct, count(DISTINCT t.node) AS n_nodes, (SELECT count(*) FROM scored s WHERE s.source IN (SELECT node FROM top x WHERE x.pct = t.pct) AND s.target IN (SELECT node FROM top x WHERE x.pct = t.pct)) AS n_edges FROM top t GROUP BY pct""")
def snapshot_pct(spark, d):
    edges = _scored(spark, d)
    deg = graph.degree(edges)
    placed = ranked(deg, F.desc("degree"), F.col("node")).crossJoin(F.broadcast(deg.agg(F.count("*").alias("n"))))
    top = placed.withColumn("pct", F.explode(F.array(*map(F.lit, (1, 5, 10, 25, 50, 100))))).filter(F.col("place") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * F.col("pct") / 100.0, 0))).select("pct", "node")
    inner = edges.join(top.select("pct", F.col("node").alias("source")), "source").join(top.select("pct", F.col("node").alias("target")), ["pct", "target"]).groupBy("pct").agg(F.count("*").alias("n_edges"))
    return top.groupBy("pct").agg(F.count("*").alias("n_nodes")).join(inner, "pct", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


@query()
def communities(spark, d):
    return community.communities(cut(_pairs(spark, d)))


@query()
def label_groups(spark, d):
    return graph.label_propagation(cut(_pairs(spark, d)))


@query()
def eigen_centrality(spark, d):
    return graph.eigenvector(cut(_pairs(spark, d))).select("node", r6("centrality").alias("centrality"))


@query(f"WITH {BACKBONE}, top AS (SELECT node FROM degrees ORDER BY degree DESC, node LIMIT 50) SELECT source, target, weight FROM scored WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top)")
def induced_subgraph(spark, d):
    edges = _scored(spark, d)
    return graph.induced(edges, graph.degree(edges).orderBy(F.desc("degree"), "node").limit(50)).select("source", "target", "weight")


# ---------------------------------------------------------------- timeline
KINDS_SQL = "SELECT DISTINCT event_type FROM events"


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def timeline_pivot(spark, d):
    return at(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("SELECT CAST(CAST(e.ts AS DATE) AS VARCHAR) AS day, o.o_orderpriority AS priority, count(*) AS n FROM events e JOIN orders o ON e.user_id = o.o_custkey GROUP BY ALL")
def chronology(spark, d):
    seen = at(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("a"))
    bought = at(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("b"))
    return seen.join(bought, "user_id").groupBy("day", "priority").agg(F.sum(F.col("a") * F.col("b")).alias("n"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_before FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id")
def asof_classification(spark, d):
    return timeline.as_of(at(spark, d, "events"), "2024-01-15 00:00:00")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def docs_without_events(spark, d):
    return at(spark, d, "customer").join(at(spark, d, "events"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""WITH e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY ALL)
SELECT user_id, day, len(v) AS n, list_reduce(v, lambda a, x: 0.7 * a + 0.3 * x) AS smoothed FROM e""")
def temporal_decay(spark, d):
    """Not rounded: both engines do the same operations in the same order."""
    return timeline.decay(at(spark, d, "events"))


@query("""WITH s AS (SELECT event_type, min(epoch_ms(ts)) AS a, max(epoch_ms(ts)) AS b FROM events GROUP BY 1), g AS (SELECT min(a) AS lo, max(b) AS hi FROM s)
SELECT event_type, round((a - lo) / (hi - lo)::DOUBLE, 6) AS start_share, round((b - a) / (hi - lo)::DOUBLE, 6) AS width FROM s, g""")
def step_intervals(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    s = at(spark, d, "events").groupBy("event_type").agg(F.min(ms).alias("a"), F.max(ms).alias("b"))
    g = F.broadcast(s.agg(F.min("a").alias("lo"), F.max("b").alias("hi")))
    span = F.col("hi") - F.col("lo")
    return s.crossJoin(g).select("event_type", r6((F.col("a") - F.col("lo")) / span).alias("start_share"), r6((F.col("b") - F.col("a")) / span).alias("width"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    found = streams.run_once(streams.window_counts(streams.stream(spark, d, "events")), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total").alias("total"))


@query("""WITH e AS (SELECT event_type, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1) SELECT event_type, len(v) AS n, round(list_reduce(v, lambda a, x: 0.7 * a + 0.3 * x), 6) AS smoothed FROM e""")
def stream_smoothing(spark, d):
    found = streams.run_once(streams.smoothing(streams.stream(spark, d, "events")), "update")
    return found.groupBy("event_type").agg(F.max("n").alias("n"), r6(F.max_by("smoothed", "n")).alias("smoothed"))


# ---------------------------------------------------------------- service
@query("""WITH f AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, strpos(lower(text), 'tion') AS p FROM documents UNION ALL SELECT 'conversation', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), strpos(lower(text), 'tion') FROM conversations)
SELECT kind, id, 1.0 / p AS score FROM f WHERE p > 0 ORDER BY score DESC, kind, id LIMIT 20""")
def search(spark, d):
    talk = at(spark, d, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return service.search([("document", at(spark, d, "documents"), "doc_id", "text"), ("conversation", talk, "id", "text")], "tion")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def paging(spark, d):
    return service.page(at(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 50, 25)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, strlen(text) AS size_bytes, sha256(text) AS sha256 FROM documents")
def manifest(spark, d):
    return service.manifest(at(spark, d, "documents"), "doc_id", "text")


@query("SELECT CASE WHEN doc_id % 50 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'size' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1")
def verify_manifest(spark, d):
    said = service.manifest(at(spark, d, "documents"), "doc_id", "text")
    there = said.filter("cast(path as long) % 50 <> 0").withColumn("size_bytes", F.when(F.col("path").cast("long") % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return service.verify(said, there).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {COMPONENTS} SELECT m.node, m.compound_id, d.degree, p_name, p_brand, (SELECT count(*) FROM lineitem WHERE l_partkey = m.node) AS n_lines FROM members m JOIN degrees d ON m.node = d.node JOIN part ON p_partkey = m.node""")
def element_detail(spark, d):
    edges = _scored(spark, d)
    lines = at(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("n_lines"))
    df = _members(edges).join(graph.degree(edges), "node").join(at(spark, d, "part"), F.col("node") == F.col("p_partkey")).join(lines, "node", "left")
    return df.select("node", "compound_id", "degree", "p_name", "p_brand", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("""SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def attribute_rollup(spark, d):
    j = at(spark, d, "orders").join(at(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(at(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(at(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- simulation, language
@query()
def agent_simulation(spark, d):
    state = simulation.init(spark, 512)
    for k in range(3):
        state = simulation.step(state, seed=11 + k)
    return simulation.metrics(simulation.inject(state, 0.5, 0.5, 0.2, 0.9, 2))


TALK = """w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations) t)"""


def _talk(spark, d):
    t = at(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
    return t.select("doc_id", F.posexplode("w").alias("place", "word"))


@query(f"""WITH {TALK}, f AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) + 3 AS id FROM w GROUP BY word HAVING count(*) >= 2),
c AS (SELECT doc_id, CAST(floor(place / 128) AS INT) AS chunk, list(coalesce(id, 3) ORDER BY place) AS ids FROM w LEFT JOIN f ON w.word = f.word GROUP BY ALL)
SELECT doc_id, chunk, array_to_string(list_concat([1], ids, [2]), ',') AS ids FROM c WHERE len(ids) >= 4""")
def element_sequences(spark, d):
    return language.sequences(_talk(spark, d)).select("doc_id", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""WITH {TALK}, p AS (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY place) AS nxt FROM w), q AS (SELECT * FROM p WHERE nxt IS NOT NULL),
n AS (SELECT word, nxt, count(*) AS n FROM q GROUP BY ALL), t AS (SELECT word, sum(n) AS total FROM n GROUP BY 1), v AS (SELECT count(DISTINCT word) AS v FROM w)
SELECT doc_id, round(exp(-avg(ln((n + 1.0) / (total + v)))), 4) AS perplexity, count(*) AS n_pairs FROM q JOIN n USING (word, nxt) JOIN t USING (word), v GROUP BY doc_id""")
def bigram_perplexity(spark, d):
    return language.bigram_perplexity(_talk(spark, d)).select("doc_id", F.round("perplexity", 4).alias("perplexity"), "n_pairs")


from spanloom.plans import library  # noqa: E402, F401  registers its queries here
