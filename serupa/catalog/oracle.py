"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Stopwords of titles, stated here again so that a wrong list would show.
STOPWORDS = (
    "dan", "yang", "untuk", "pada", "dengan", "dari", "ke", "di", "ini", "itu", "atau", "sebagai", "dalam", "tentang",
    "oleh", "adalah", "adapun", "serta", "sebuah", "ia", "juga", "rancang", "bangun", "sistem", "aplikasi", "metode",
    "studi", "kasus", "algoritma", "perancangan", "pembuatan", "penerapan", "berbasis", "menggunakan", "analisis",
    "implementasi", "uji", "kinerja", "evaluasi", "pengembangan", "model", "rancangan", "prototipe", "prototype",
    "berbasiskan", "mengimplementasikan", "menganalisis", "berupa", "laporan", "tugas", "akhir", "skripsi", "kerja",
    "praktek", "praktik", "kp", "of", "the", "and", "in", "on", "for", "with", "a", "an", "to", "based", "using",
    "system",
)

WS = r"[\s\x0b\p{Z}\x1c-\x1f\x{85}]"
STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
TEXTS = r"'[\p{L}\p{N}]+'"


# --- expressions ------------------------------------------------------------------------------


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def words(t: str) -> str:
    joined = (
        f"regexp_replace(lower({t}), '(^|[^\\p{{L}}\\p{{N}}_])([a-z0-9]+)[-/.](([a-z0-9]+)\\b)?', '\\1\\2\\4', 'g')"
    )
    plain = f"regexp_replace({joined}, '[^a-z0-9\\s]', ' ', 'g')"
    return (
        f"list_filter(regexp_split_to_array({plain}, '\\s+'), "
        f"lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))"
    )


def clean(t: str) -> str:
    return f"coalesce(nullif(array_to_string({words(t)}, ' '), ''), {strip(t)}, '')"


def word_set(t: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array({t}, '{WS}+')), lambda w: w <> '')"


def set_jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both} / nullif((len({a}) + len({b}) - {both})::DOUBLE, 0), 0.0)"


def jaccard(a: str, b: str) -> str:
    return set_jaccard(word_set(a), word_set(b))


def with_words(name: str) -> str:
    """CTE ``name_w``(k, ws): word sets of the cleaned texts, computed once."""
    return f"{name}_w AS MATERIALIZED (SELECT k, {word_set('cleaned')} AS ws FROM {name})"


def r4(x: str) -> str:
    return f"printf('%.4f', {x})::DOUBLE"


def persen(x: str) -> str:
    return f"printf('%.1f%%', {x} * 100)"


def level(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 0.85 THEN 'SANGAT TINGGI' WHEN {x} >= 0.70 THEN 'TINGGI' "
        f"WHEN {x} >= 0.50 THEN 'SEDANG' ELSE 'RENDAH' END"
    )


def snap(x: str, digits: int = 10) -> str:
    return f"(floor({x} * 1e{digits} + 0.5) / 1e{digits})"


def hybrid(semantic: str, lexical: str) -> str:
    return r4(f"({semantic} * 0.7::DOUBLE + {lexical} * 0.3::DOUBLE)")


# --- relations --------------------------------------------------------------------------------


def hashed(name: str, source: str, text: str, key: str = "k", dim: int = 256) -> str:
    """CTEs for the unit hash vectors of a text column: ``name``(k, b, v) and ``name_len``(k, l)."""
    return f"""
{name}_tok AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), {TEXTS})) AS t FROM {source}),
{name}_cnt AS (
  SELECT k, CAST(('0x' || substr(md5(t), 1, 8))::UBIGINT % {dim} AS INTEGER) AS b,
         sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS n
  FROM {name}_tok GROUP BY ALL),
{name}_nrm AS (SELECT k, sqrt(sum(n * n)) AS s FROM {name}_cnt GROUP BY k),
{name} AS (SELECT k, b, (n / s)::FLOAT::DOUBLE AS v FROM {name}_cnt JOIN {name}_nrm USING (k) WHERE n <> 0),
{length_of(name)}"""


def length_of(name: str, dim: int = 256) -> str:
    """CTEs: vector lengths and the vectors as fixed-size arrays."""
    return f"""{name}_len AS (SELECT k, sqrt(sum(v * v)) AS l FROM {name} GROUP BY k),
{name}_all AS (SELECT k, b, sum(v) AS v FROM (
  SELECT k, b, v FROM {name} UNION ALL SELECT k, unnest(range({dim}))::INTEGER, 0.0::DOUBLE FROM {name}_len) GROUP BY ALL),
{name}_arr AS (SELECT k, list(v ORDER BY b)::DOUBLE[{dim}] AS e FROM {name}_all GROUP BY k)"""


def cosines(q: str, c: str) -> str:
    """Snapped cosines of all pairs of texts with tokens: (qk, ck, cosine)."""
    return f"""
  SELECT x.k AS qk, y.k AS ck, {snap("(array_inner_product(x.e, y.e) / (a.l * b.l))")} AS cosine
  FROM {q}_arr x JOIN {q}_len a ON a.k = x.k, {c}_arr y JOIN {c}_len b ON b.k = y.k"""


def doc_type(n: str) -> str:
    return f"CASE WHEN {n} % 3 = 0 THEN 'internship_report' ELSE 'skripsi' END"


def docs(n: str = "doc_id") -> str:
    return f"""
docs AS (
  SELECT concat_ws('_', {doc_type(n)}, {n}::VARCHAR) AS document_id, {doc_type(n)} AS document_type,
         {n} AS skripsi_id, text AS judul,
         CASE WHEN {n} % 7 <> 0 THEN (1990 + {n} % 35)::INTEGER END AS tahun,
         CASE WHEN {n} % 11 <> 0 THEN source END AS program_studi
  FROM documents)"""


PAGES = f"""
pg AS (
  SELECT concat_ws('_', {doc_type("page_id")}, page_id::VARCHAR) AS document_id, {doc_type("page_id")} AS document_type,
         CASE WHEN page_id % 3 <> 0 THEN page_id END AS skripsi_id, page_id AS n,
         regexp_extract(html, '<title>(.*?)</title>', 1) AS judul,
         regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS abstrak,
         array_to_string(regexp_extract_all(html, '<a href="/([^"]*)">', 1), ', ') AS kata_kunci,
         CASE WHEN page_id % 7 <> 0 THEN (1990 + page_id % 35)::INTEGER END AS tahun,
         regexp_extract(url, '^https?://([^/]+)', 1) AS program_studi,
         CASE WHEN page_id % 4 = 1 THEN (page_id % 5 - 1)::DOUBLE END AS bobot_judul,
         CASE WHEN page_id % 4 = 2 THEN (page_id % 5 - 1)::DOUBLE END AS bobot_abstrak,
         CASE WHEN page_id % 4 = 3 THEN (page_id % 5 - 1)::DOUBLE END AS bobot_kata_kunci
  FROM pages)"""

BENCH = """
bench AS (
  SELECT item_id AS query_id, text AS judul, (1 + item_id % 20)::INTEGER AS top_k,
         0.35::DOUBLE + (item_id % 4) * 0.05::DOUBLE AS threshold,
         CASE item_id % 3 WHEN 1 THEN 'skripsi' WHEN 2 THEN 'internship_report' END AS document_type
  FROM benchmark WHERE length(text) >= 5)"""


def parsed(id_: str, stored: str) -> tuple[str, str]:
    """Number and type read from a hit id."""
    last = f"try_cast(trim(string_split({id_}, '_')[-1]) AS BIGINT)"
    number = (
        f"CASE WHEN contains({id_}, '_') THEN coalesce({last}, 0) "
        f"WHEN regexp_full_match({id_}, '[0-9]+') THEN {id_}::BIGINT ELSE 0 END"
    )
    kind = (
        f"CASE WHEN contains({id_}, '_') THEN CASE WHEN {last} IS NULL THEN 'unknown' "
        f"ELSE regexp_replace({id_}, '_[^_]*$', '') END ELSE coalesce({stored}, 'skripsi') END"
    )
    return number, kind


def weighted_pages() -> str:
    """CTEs: ``pw`` resolved weights and ``pv`` the stored vectors of page documents."""
    def given(column: str, default: float) -> str:
        return f"greatest(coalesce({column}, {default}::DOUBLE), 0.0)"

    share = lambda w, d: f"CASE WHEN j + a + w > 1e-9 THEN {w} / (j + a + w) ELSE {d}::DOUBLE END"
    return f"""
pw0 AS (SELECT document_id AS k, {given("bobot_judul", 0.7)} AS j, {given("bobot_abstrak", 0.2)} AS a,
               {given("bobot_kata_kunci", 0.1)} AS w FROM pg),
pw AS (SELECT k, {share("j", 0.7)} AS wj, {share("a", 0.2)} AS wa, {share("w", 0.1)} AS ww FROM pw0),
pc AS (SELECT document_id AS k, document_type, judul, {clean("judul")} AS cleaned,
              substring({strip("abstrak")}, 1, 300) AS abs_text, {strip("kata_kunci")} AS kw_text FROM pg),
{hashed("pj", "pc", "cleaned")},
{hashed("pa", "pc", "abs_text")},
{hashed("pk", "pc", "kw_text")},
psum AS (
  SELECT k, b, sum(x) AS x FROM (
    SELECT k, b, v * wj AS x FROM pj JOIN pw USING (k) UNION ALL
    SELECT k, b, v * wa FROM pa JOIN pw USING (k) UNION ALL
    SELECT k, b, v * ww FROM pk JOIN pw USING (k)) GROUP BY ALL),
plen AS (SELECT k, sqrt(sum(x * x)) AS l FROM psum GROUP BY k),
pv AS (SELECT k, b, (CASE WHEN l > 1e-9 THEN x / l ELSE x END)::FLOAT::DOUBLE AS v FROM psum JOIN plen USING (k)),
{length_of("pv")}"""


# --- search -----------------------------------------------------------------------------------

STOPWORD_CTE = """
wd AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(lower(judul), '[a-z0-9]{3,}')) AS word
       FROM docs WHERE judul <> ''),
sw AS (SELECT word, count(*) AS n, count(*) / (SELECT count(*) FROM docs WHERE judul <> '')::DOUBLE AS df
       FROM wd GROUP BY word HAVING df >= 0.15),
swl AS MATERIALIZED (SELECT coalesce(list(word), []) AS dyn FROM sw)"""


def clean_dynamic(t: str) -> str:
    """Cleaned with the stopwords ``dyn`` of the row as well."""
    kept = f"list_filter({words(t)}, lambda w: NOT list_contains(dyn, w))"
    return f"coalesce(nullif(array_to_string({kept}, ' '), ''), {strip(t)}, '')"


_number, _kind = parsed("id", "document_type")


def check(dynamic: bool) -> str:
    """Benchmark texts against all documents; index vectors are made without dynamic stopwords."""
    stop, asked, stored = ("", clean("judul"), "dc") if not dynamic else (f"{STOPWORD_CTE},", clean_dynamic("judul"), "dd")
    again = f"dd AS MATERIALIZED (SELECT document_id AS k, {clean_dynamic('judul')} AS cleaned FROM docs, swl)," if dynamic else ""
    return f"""
WITH {docs()}, {BENCH}, {stop}
qc AS (SELECT query_id AS k, judul, top_k, threshold, document_type, {asked} AS cleaned FROM bench{", swl" if dynamic else ""}),
dc AS MATERIALIZED (SELECT document_id AS k, document_type, {clean("judul")} AS cleaned FROM docs),
{again}
{with_words("qc")}, {with_words(stored)},
{hashed("qv", "qc", "cleaned")},
{hashed("dv", "dc", "cleaned")},
pairs AS ({cosines("qv", "dv")}),
ranked AS (
  SELECT qc.k AS query_id, dc.k AS id, dc.document_type, cosine, threshold, top_k,
         row_number() OVER (PARTITION BY qc.k ORDER BY cosine DESC, dc.k) AS semantic_rank
  FROM pairs JOIN qc ON qc.k = qk JOIN dc ON dc.k = ck
  WHERE qc.document_type IS NULL OR qc.document_type = dc.document_type),
scored AS (
  SELECT r.*, {hybrid(r4("cosine"), set_jaccard("a.ws", "b.ws"))} AS similarity_score
  FROM ranked r JOIN qc_w a ON a.k = query_id JOIN {stored}_w b ON b.k = id WHERE semantic_rank <= top_k),
hits AS (
  SELECT query_id, id, {_number} AS document_id, {_kind} AS document_type, similarity_score,
         {persen("similarity_score")} AS similarity_persen, {level("similarity_score")} AS level, semantic_rank
  FROM scored WHERE similarity_score >= threshold)
"""


CHECK = check(False)
HITS = """
SELECT query_id, id, document_id, document_type, CASE WHEN document_type = 'skripsi' THEN document_id END AS skripsi_id,
       similarity_score, similarity_persen, level FROM hits
"""
ORACLE["similarity_check"] = CHECK + HITS
ORACLE["stream_check"] = CHECK + HITS
ORACLE["similarity_check_dynamic"] = check(True) + HITS
ORACLE["similarity_summary"] = CHECK + """
SELECT b.query_id, b.judul, count(h.id) AS total_found,
       coalesce(string_agg(h.id || '=' || h.similarity_persen, ';'
                           ORDER BY h.similarity_score DESC, h.semantic_rank), '') AS results,
       CASE WHEN max(h.similarity_score) >= 0.85 THEN
         'Ditemukan judul dengan kemiripan SANGAT TINGGI (' ||
         arg_max(h.similarity_persen, h.similarity_score) ||
         '). Pertimbangkan untuk merevisi judul atau topik penelitian Anda.' END AS peringatan
FROM bench b LEFT JOIN hits h USING (query_id) GROUP BY b.query_id, b.judul
"""


def self_check(ctes: str, vectors: str, queries: str, texts: str, key: str, threshold: float = 0.5) -> str:
    """Every document against all others, top 5."""
    return f"""
WITH {ctes}, {with_words(texts)},
pairs AS ({cosines(queries, vectors)}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qk ORDER BY cosine DESC, ck) AS semantic_rank FROM pairs WHERE qk <> ck),
scored AS (
  SELECT r.*, {hybrid(r4("cosine"), set_jaccard("a.ws", "b.ws"))} AS similarity_score
  FROM ranked r JOIN {texts}_w a ON a.k = qk JOIN {texts}_w b ON b.k = ck WHERE semantic_rank <= 5)
SELECT qk AS {key}, ck AS id, similarity_score, {persen("similarity_score")} AS similarity_persen,
       {level("similarity_score")} AS level, semantic_rank::INTEGER AS semantic_rank
FROM scored WHERE similarity_score >= {threshold}
"""


ORACLE["near_duplicates"] = self_check(
    f"{docs()}, dc AS MATERIALIZED (SELECT document_id AS k, {clean('judul')} AS cleaned FROM docs), {hashed('dv', 'dc', 'cleaned')}",
    "dv", "dv", "dc", "source_id",
)
ORACLE["near_duplicates_cells"] = ORACLE["near_duplicates"]
ORACLE["similarity_check_weighted"] = self_check(f"{PAGES}, {weighted_pages()}", "pv", "pj", "pc", "query_id")


def vector_topk(where: str, k: str = "5") -> str:
    return f"""
WITH v AS (
  SELECT vec_id, 'v' || vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM v),
pairs AS (
  SELECT q.vec_id AS query_id, c.id, {snap("(list_inner_product(q.e, c.e) / (q.l * c.l))")} AS cosine
  FROM n q, n c WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS r FROM pairs)
SELECT query_id, id, {r4("cosine")} AS similarity_score, r::INTEGER AS rank FROM ranked WHERE r <= {k}
"""


ORACLE["vector_topk"] = vector_topk("true")
ORACLE["vector_topk_filtered"] = vector_topk("q.vec_id % 4 = 0 OR q.label = c.label")
ORACLE["vector_topk_exclude_self"] = vector_topk("q.vec_id <> c.vec_id")
ORACLE["vector_topk_large_k"] = vector_topk("true", "query_id % 3 * 10 + 30")
ORACLE["vector_topk_cells"] = ORACLE["vector_topk_exclude_self"]
ORACLE["vector_topk_tiled"] = vector_topk("q.vec_id <> c.vec_id")


# --- pairs ------------------------------------------------------------------------------------

TURNS = """
turns AS (
  SELECT a.conv_id, a.turn, a.text AS judul_a, b.text AS judul_b
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""
def compared(stop: str, cleaned, words_of: str) -> str:
    return f"""
WITH {stop} {TURNS},
side AS (
  SELECT conv_id || '/' || turn || '/a' AS k, {cleaned("judul_a")} AS cleaned FROM turns{words_of} UNION ALL
  SELECT conv_id || '/' || turn || '/b' AS k, {cleaned("judul_b")} FROM turns{words_of}),
{hashed("sv", "side", "cleaned")},
dots AS (
  SELECT conv_id, turn, sum(x.v * y.v) AS s FROM turns
  JOIN sv x ON x.k = conv_id || '/' || turn || '/a'
  JOIN sv y ON y.k = conv_id || '/' || turn || '/b' AND y.b = x.b GROUP BY ALL),
scored AS (
  SELECT t.conv_id, t.turn, {jaccard("ca.cleaned", "cb.cleaned")} AS lexical,
         coalesce({snap("(d.s / (la.l * lb.l))")}, 0.0) AS semantic
  FROM turns t
  JOIN side ca ON ca.k = t.conv_id || '/' || t.turn || '/a'
  JOIN side cb ON cb.k = t.conv_id || '/' || t.turn || '/b'
  LEFT JOIN dots d ON d.conv_id = t.conv_id AND d.turn = t.turn
  LEFT JOIN sv_len la ON la.k = ca.k LEFT JOIN sv_len lb ON lb.k = cb.k),
final AS (SELECT *, {hybrid("semantic", "lexical")} AS similarity_score FROM scored)
SELECT conv_id, turn, similarity_score, {persen("similarity_score")} AS similarity_persen,
       {level("similarity_score")} AS level, {r4("semantic")} AS semantic_score, {r4("lexical")} AS lexical_score FROM final
"""


ORACLE["compare_pairs"] = compared("", clean, "")
ORACLE["compare_pairs_dynamic"] = compared(f"{docs()}, {STOPWORD_CTE},", clean_dynamic, ", swl")
ORACLE["jaccard_pairs"] = f"""
WITH {TURNS}
SELECT conv_id, turn, {jaccard("judul_a", "judul_b")} AS jaccard,
       {jaccard(clean("judul_a"), clean("judul_b"))} AS jaccard_clean FROM turns
"""
ORACLE["similarity_levels"] = f"""
WITH s AS (SELECT event_id, value / (100.0 + value) AS score FROM events)
SELECT event_id, {r4("score")} AS score, {persen("score")} AS persen, {level("score")} AS level FROM s
"""
_number, _kind = parsed("id", "stored_type")
ORACLE["parse_hit_ids"] = f"""
WITH rows_ AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'skripsi_' || doc_id WHEN 1 THEN 'internship_report_' || doc_id
                 WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN 'draft_' || source ELSE source END AS id, lang AS stored_type
  FROM documents),
p AS (SELECT doc_id, id, {_number} AS document_id, {_kind} AS document_type FROM rows_)
SELECT *, CASE WHEN document_type = 'skripsi' THEN document_id END AS skripsi_id FROM p
"""


# --- vectors ----------------------------------------------------------------------------------

ORACLE["l2_normalize"] = f"""
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 2)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM s)
SELECT vec_id, (i - 1)::INTEGER AS pos, {snap("(e[i] / l)", 6)} AS value
FROM n, (SELECT unnest(range(1, 65)) AS i)
"""
ORACLE["weighted_embedding"] = f"""
WITH c AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
s AS (
  SELECT a.vec_id, a.i, a.x * 0.7::DOUBLE + coalesce(b.x * 0.2::DOUBLE, 0) + coalesce(d.x * 0.1::DOUBLE, 0) AS x FROM c a
  LEFT JOIN c b ON b.vec_id = a.vec_id + 1 AND b.i = a.i LEFT JOIN c d ON d.vec_id = a.vec_id + 2 AND d.i = a.i),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM s GROUP BY vec_id)
SELECT vec_id, (i - 1)::INTEGER AS pos, {snap("((x / l)::FLOAT::DOUBLE)", 6)} AS value FROM s JOIN n USING (vec_id)
"""
ORACLE["mean_pool"] = f"""
SELECT label, (i - 1)::INTEGER AS pos,
       {snap("(coalesce(sum(embedding[i]::DOUBLE) FILTER (WHERE vec_id % 3 <> 0), 0) / greatest(count(*) FILTER (WHERE vec_id % 3 <> 0), 1e-9::DOUBLE))", 6)} AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i
"""


# --- text -------------------------------------------------------------------------------------

ORACLE["clean_titles"] = f"""
WITH {docs()}, {PAGES},
t AS (SELECT document_id, judul FROM docs UNION ALL SELECT 'page_' || document_id, judul FROM pg)
SELECT document_id, {clean("judul")} AS clean FROM t
"""
ORACLE["dynamic_stopwords"] = f"WITH {docs()}, {STOPWORD_CTE} SELECT word, n, df FROM sw"
ORACLE["clean_titles_dynamic"] = f"""
WITH {docs()}, {STOPWORD_CTE},
ws AS (SELECT document_id, {words("judul")} AS w FROM docs),
x AS (SELECT document_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM ws),
k AS (SELECT document_id, string_agg(word, ' ' ORDER BY place) AS kept
      FROM x WHERE word NOT IN (SELECT word FROM sw) GROUP BY document_id)
SELECT d.document_id, coalesce(k.kept, {strip("d.judul")}, '') AS clean FROM docs d LEFT JOIN k USING (document_id)
"""
ORACLE["index_text"] = f"""
WITH {PAGES}
SELECT document_id, concat_ws(' | ', {strip("judul")},
         CASE WHEN abstrak <> '' THEN substring({strip("abstrak")}, 1, 300) END,
         CASE WHEN kata_kunci <> '' THEN {strip("kata_kunci")} END) AS index_text,
       {strip("judul")} AS query_text FROM pg
"""
ORACLE["resolve_weights"] = f"""
WITH g AS (
  SELECT doc_id,
    greatest(coalesce(CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 5 - 1)::DOUBLE END, 0.7::DOUBLE), 0) AS j,
    greatest(coalesce(CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 4 - 1)::DOUBLE END, 0.2::DOUBLE), 0) AS a,
    greatest(coalesce(CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 3 - 1)::DOUBLE END, 0.1::DOUBLE), 0) AS w FROM documents),
t AS (SELECT *, j + a + w AS s FROM g)
SELECT doc_id, {r4("CASE WHEN s > 1e-9 THEN j / s ELSE 0.7::DOUBLE END")} AS judul,
       {r4("CASE WHEN s > 1e-9 THEN a / s ELSE 0.2::DOUBLE END")} AS abstrak,
       {r4("CASE WHEN s > 1e-9 THEN w / s ELSE 0.1::DOUBLE END")} AS kata_kunci FROM t
"""
ORACLE["encode_documents"] = f"""
WITH {PAGES}, {weighted_pages()}
SELECT k AS document_id, b AS bucket, {snap("v", 6)} AS value FROM pv WHERE {snap("v", 6)} <> 0
"""
ORACLE["encode_documents_model"] = ORACLE["encode_documents"]


# --- intake -----------------------------------------------------------------------------------

RAW = """
raw AS (
  SELECT doc_id AS row, CASE doc_id % 6 WHEN 1 THEN 'skripsi_' || doc_id WHEN 2 THEN 'x_y' || doc_id
                                        WHEN 3 THEN doc_id::VARCHAR END AS given,
         CASE doc_id % 4 WHEN 1 THEN 'internship_report' END AS type1, CASE doc_id % 8 WHEN 3 THEN 'laporan' END AS type2,
         CASE WHEN doc_id % 6 = 4 THEN doc_id::VARCHAR WHEN doc_id % 24 = 0 THEN 'abc' END AS id1,
         CASE WHEN doc_id % 12 IN (5, 6) THEN doc_id::VARCHAR END AS id2,
         text AS judul, (1980 + doc_id % 130)::INTEGER AS tahun, (doc_id % 5 - 1)::DOUBLE AS bobot_judul,
         CASE WHEN doc_id % 2 = 0 THEN (doc_id % 7 - 1)::DOUBLE END AS bobot_abstrak
  FROM documents),
nrm AS (
  SELECT *, coalesce(type1, type2, 'skripsi') AS kind, nullif(coalesce(id1, id2), '0') AS sid,
         string_split(given, '_')[-1] AS tail FROM raw),
ids AS (
  SELECT *, coalesce(given, kind || '_' || sid) AS document_id, kind AS document_type,
         CASE WHEN sid IS NOT NULL THEN try_cast(sid AS BIGINT)
              WHEN contains(given, '_') AND regexp_full_match(tail, '[0-9]+') THEN try_cast(tail AS BIGINT) END AS skripsi_id,
         CASE WHEN sid IS NOT NULL AND try_cast(sid AS BIGINT) IS NULL THEN 'source_id_not_integer'
              WHEN sid IS NULL AND given IS NULL THEN 'id_missing' END AS id_error FROM nrm)"""
ORACLE["normalize_ids"] = f"WITH {RAW} SELECT row, document_id, document_type, skripsi_id, id_error FROM ids"
ORACLE["validate_docs"] = f"""
WITH {RAW}
SELECT row, concat_ws(',', id_error,
  CASE WHEN judul IS NULL THEN 'judul_missing' END,
  CASE WHEN length(judul) < 5 THEN 'judul_too_short' END, CASE WHEN length(judul) > 500 THEN 'judul_too_long' END,
  CASE WHEN tahun < 1990 THEN 'tahun_too_small' END, CASE WHEN tahun > 2100 THEN 'tahun_too_large' END,
  CASE WHEN bobot_judul < 0 THEN 'bobot_judul_negative' END,
  CASE WHEN bobot_abstrak < 0 THEN 'bobot_abstrak_negative' END) AS errors FROM ids
"""
ORACLE["validate_queries"] = f"""
WITH q AS (
  SELECT doc_id AS query_id, CASE WHEN doc_id % 50 <> 0 THEN text END AS judul,
         coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 24 END, 5)::INTEGER AS top_k,
         coalesce(CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 13) / 10.0::DOUBLE - 0.1::DOUBLE END, 0.5::DOUBLE) AS threshold
  FROM documents)
SELECT query_id, top_k, {r4("threshold")} AS threshold, concat_ws(',',
  CASE WHEN judul IS NULL THEN 'judul_missing' END, CASE WHEN length(judul) < 5 THEN 'judul_too_short' END,
  CASE WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k_out_of_range' END,
  CASE WHEN threshold NOT BETWEEN 0 AND 1 THEN 'threshold_out_of_range' END) AS errors FROM q
"""
META = """
meta AS (SELECT document_id, document_type, skripsi_id, coalesce(tahun, 0) AS tahun,
                coalesce(nullif(program_studi, ''), 'Tidak Diketahui') AS program_studi, judul FROM docs)"""
ORACLE["build_metadata"] = f"WITH {docs()}, {META} SELECT * FROM meta"
EXPORT = f"""
{PAGES},
ex AS (SELECT *, CASE WHEN n % 7 = 0 OR n % 11 = 0 OR n % 13 = 0 THEN NULL ELSE n END AS sid FROM pg)"""
ORACLE["reindex_ingest"] = f"""
WITH {EXPORT}
SELECT 'skripsi_' || sid AS document_id, 'skripsi' AS document_type, sid AS skripsi_id, judul, tahun,
       program_studi, NULL::VARCHAR AS nim
FROM ex WHERE sid IS NOT NULL AND length(judul) BETWEEN 5 AND 500 AND (tahun IS NULL OR tahun BETWEEN 1990 AND 2100)
"""
ORACLE["reindex_ingest_array"] = ORACLE["reindex_ingest"]
ORACLE["reindex_counters"] = f"""
WITH {EXPORT},
st AS (SELECT CASE WHEN sid IS NULL THEN 'skipped' WHEN length(judul) NOT BETWEEN 5 AND 500 THEN 'failed' ELSE 'sent' END AS s
       FROM ex)
SELECT counter, count(*) AS n FROM (SELECT s AS counter FROM st UNION ALL SELECT 'received' FROM st) GROUP BY counter
"""
ORACLE["payload_roundtrip"] = f"""
WITH {PAGES}
SELECT (n // 100)::BIGINT AS batch, (n // 100) % 2 = 0 AS reset_index, document_id, document_type, skripsi_id,
       judul, abstrak, tahun, bobot_judul FROM pg
"""


# --- index ------------------------------------------------------------------------------------

CONTENT = f"""
{weighted_pages()},
pdig AS (SELECT k, sum(v * (b + 1)) AS d FROM pv GROUP BY k),
base AS (SELECT document_id AS id, judul AS document, document_type, skripsi_id, coalesce(tahun, 0) AS tahun,
                coalesce(nullif(program_studi, ''), 'Tidak Diketahui') AS program_studi,
                coalesce({snap("d", 6)}, 0.0) AS digest FROM pg LEFT JOIN pdig ON k = document_id)"""


def changes(winners: str) -> str:
    """CTEs: events as changes, the saves that win, and their digests (the title's weight is the only one that counts)."""
    return f"""
ev AS (SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, 'skripsi_' || user_id AS id,
              event_type || ' ' || props AS document, 'skripsi' AS document_type, user_id AS skripsi_id,
              (2000 + event_id % 25)::INTEGER AS tahun, event_type AS program_studi, ts FROM events),
last_ AS (SELECT * FROM ev {winners} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, document DESC) = 1),
ec AS (SELECT id AS k, {clean("document")} AS cleaned FROM last_),
{hashed("eh", "ec", "cleaned")},
ew AS (SELECT k, b, v * 0.7::DOUBLE AS x FROM eh),
el AS (SELECT k, sqrt(sum(x * x)) AS n FROM ew GROUP BY k),
edig AS (SELECT k, sum((x / n)::FLOAT::DOUBLE * (b + 1)) AS d FROM ew JOIN el USING (k) GROUP BY k),
saved AS (SELECT id, document, document_type, skripsi_id, tahun, program_studi, coalesce({snap("d", 6)}, 0.0) AS digest
          FROM last_ LEFT JOIN edig ON k = id WHERE op = 'upsert')"""


SAVES, CHANGES = changes("WHERE op = 'upsert'"), changes("")
COLUMNS = "id, document, document_type, skripsi_id, tahun, program_studi, digest"
ORACLE["index_build"] = f"WITH {PAGES}, {CONTENT} SELECT {COLUMNS} FROM base"
ORACLE["index_upsert"] = f"""
WITH {PAGES}, {CONTENT}, {SAVES}
SELECT {COLUMNS} FROM base WHERE id NOT IN (SELECT id FROM saved) UNION ALL SELECT {COLUMNS} FROM saved
"""
ORACLE["index_delete"] = f"""
WITH {PAGES}, {CONTENT}, {SAVES} SELECT {COLUMNS} FROM base WHERE id NOT IN (SELECT id FROM ev WHERE op = 'delete')
"""
ORACLE["index_replace"] = f"WITH {SAVES} SELECT {COLUMNS} FROM saved"
ORACLE["stream_sync"] = f"WITH {CHANGES} SELECT {COLUMNS} FROM saved"
ORACLE["index_upsert_payload"] = f"""
WITH {PAGES}
SELECT document_id AS id, CASE WHEN n % 3 = 0 OR least(bobot_judul, bobot_abstrak, bobot_kata_kunci) < 0 OR length(judul) + 8 NOT BETWEEN 5 AND 500
                               THEN judul ELSE judul || ' edisi ' || (n % 3) END AS document,
       document_type, skripsi_id, coalesce(tahun, 0) AS tahun FROM pg
"""
ORACLE["index_count"] = "SELECT count(*) AS total_indexed FROM documents"
ORACLE["ingest_verify"] = f"""
WITH {docs()}, {PAGES},
s AS (SELECT (SELECT count(DISTINCT document_id) FROM docs) AS d, (SELECT count(DISTINCT document_id) FROM pg) AS p),
c AS (SELECT 'replace' AS load, d AS e, d AS t, true AS r FROM s UNION ALL SELECT 'replace_short', d, p, true FROM s
      UNION ALL SELECT 'merge', p, d, false FROM s UNION ALL SELECT 'merge_short', d, p, false FROM s),
b AS (SELECT *, CASE WHEN r THEN t <> e ELSE t < e END AS bad FROM c)
SELECT e AS expected_total, t AS total_indexed, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN bad AND r THEN 'Jumlah vector hasil reindex tidak konsisten (expected=' || e || ', vector=' || t || ').'
            WHEN bad THEN 'Jumlah vector terindeks lebih kecil dari data yang diterima (received=' || e || ', vector='
                          || t || ').' END AS error_message, load FROM b
"""
ORACLE["indexed_ids_page"] = f"WITH {docs()} SELECT document_id AS id FROM docs WHERE document_id > 'internship_report_3' ORDER BY id LIMIT 500"
BAD = """
bad AS (SELECT document_id, id_error IS NOT NULL OR judul IS NULL OR length(judul) NOT BETWEEN 5 AND 500 OR tahun < 1990 OR tahun > 2100
               OR coalesce(bobot_judul < 0, false) OR coalesce(bobot_abstrak < 0, false) AS wrong FROM ids)"""
ORACLE["bulk_load_report"] = f"""
WITH {RAW}, {BAD},
ev AS (SELECT 'skripsi_' || user_id AS id FROM events WHERE event_type <> 'error'),
c AS (SELECT (SELECT count(*) FROM bad) AS received, (SELECT count(*) FROM bad WHERE wrong) AS wrong, (SELECT count(*) FROM ev) AS saves,
             (SELECT count(DISTINCT id) FROM (SELECT document_id AS id FROM bad WHERE NOT wrong UNION ALL SELECT id FROM ev)) AS total)
SELECT 'reset' AS job_id, 'completed' AS status, received AS total_received, wrong AS rejected, received - wrong AS total_processed,
       NULL::VARCHAR AS error_message, total AS total_indexed, 2 * wrong AS quarantined FROM c
UNION ALL SELECT 'merge', 'completed', saves, 0, saves, NULL, total, 2 * wrong FROM c
UNION ALL SELECT 'invalid', 'failed', wrong, 0, 0, 'nothing to load', total, 2 * wrong FROM c
"""
ORACLE["corpus_titles"] = "SELECT text AS title FROM documents WHERE doc_id % 9 <> 0 AND text <> ''"
ORACLE["stats_program"] = f"WITH {docs()}, {META} SELECT program_studi, count(*) AS n FROM meta GROUP BY program_studi"
ORACLE["stats_year"] = (
    f"WITH {docs()}, {META} SELECT tahun::VARCHAR AS tahun, count(*) AS n FROM meta WHERE tahun > 0 GROUP BY ALL"
)


# --- evaluation -------------------------------------------------------------------------------

PREDICTIONS = f"""
WITH {PAGES},
tc AS (SELECT n AS k, document_id, judul, abstrak, {clean("judul")} AS cleaned FROM pg),
{hashed("tv", "tc", "cleaned")},
dots AS ({cosines("tv", "tv")}),
near AS (
  SELECT a.k AS qk, b.k AS ck, a.judul AS judul_a, b.judul AS judul_b, a.cleaned AS clean_a, b.cleaned AS clean_b,
         a.abstrak AS body_a, b.abstrak AS body_b, coalesce(d.cosine, 0.0) AS cosine,
         row_number() OVER (PARTITION BY a.k ORDER BY coalesce(d.cosine, 0.0) DESC, b.document_id) AS r
  FROM tc a JOIN tc b ON a.k <> b.k LEFT JOIN dots d ON d.qk = a.k AND d.ck = b.k),
pairs AS (
  SELECT qk * 3 + r AS no, judul_a, judul_b,
         CASE WHEN {jaccard("body_a", "body_b")} >= 0.5 THEN 1 ELSE 0 END::INTEGER AS label, cosine AS semantic,
         {jaccard("clean_a", "clean_b")} AS lexical FROM near WHERE r <= 3),
pred AS (
  SELECT no, judul_a, judul_b, label, {hybrid("semantic", "lexical")} AS score,
         {r4("semantic")} AS semantic_score, {r4("lexical")} AS lexical_score FROM pairs)
"""


def metrics(thresholds: str) -> str:
    return PREDICTIONS + f""",
th AS (SELECT unnest({thresholds}) AS threshold),
cm AS (
  SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
         count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
         count(*) FILTER (WHERE score < threshold AND label = 1) AS fn,
         count(*) FILTER (WHERE score < threshold AND label = 0) AS tn FROM pred, th GROUP BY threshold),
pr AS (SELECT *, coalesce(tp / nullif((tp + fp)::DOUBLE, 0), 0.0) AS p, coalesce(tp / nullif((tp + fn)::DOUBLE, 0), 0.0) AS r
       FROM cm),
m AS (
  SELECT threshold, tp, fp, fn, tn, {r4("p")} AS precision, {r4("r")} AS recall,
         {r4("coalesce(2 * p * r / nullif(p + r, 0), 0.0)")} AS f1,
         {r4("coalesce((tp + tn) / nullif((tp + fp + fn + tn)::DOUBLE, 0), 0.0)")} AS accuracy FROM pr)
"""


SWEEP = "list_transform(range(40, 96, 5), lambda t: t / 100.0::DOUBLE)"
ORACLE["eval_predictions"] = PREDICTIONS + f"""
SELECT *, {level("score")} AS level, (score >= 0.65)::INTEGER AS predicted,
       CASE WHEN (score >= 0.65)::INTEGER = label THEN 'OK' ELSE 'SALAH' END AS status FROM pred
"""
ORACLE["eval_confusion"] = metrics("[0.5::DOUBLE]") + "SELECT * FROM m"
ORACLE["eval_target_metrics"] = metrics("[0.65::DOUBLE]") + "SELECT * FROM m"
ORACLE["eval_threshold_sweep"] = metrics(SWEEP) + "SELECT * FROM m"
ORACLE["eval_best_threshold"] = metrics(SWEEP) + "SELECT * FROM m ORDER BY f1 DESC, threshold LIMIT 1"

ORACLE["eval_predictions_file"] = PREDICTIONS + f"SELECT *, {level('score')} AS level FROM pred"
ORACLE["eval_sweep_file"] = ORACLE["eval_threshold_sweep"]
ORACLE["eval_summary_file"] = metrics(SWEEP) + """
SELECT (SELECT count(*) FROM pred) AS total_pairs, (SELECT count(*) FROM m)::INTEGER AS thresholds, threshold, tp, fp, fn, tn, f1
FROM m ORDER BY f1 DESC, threshold LIMIT 1
"""


# --- jobs -------------------------------------------------------------------------------------

JOBS = """
WITH j AS (
  SELECT user_id::VARCHAR AS job_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed'
           WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, event_id AS seq,
         event_id % 500 AS total_processed,
         CASE WHEN event_type = 'error' THEN substring(repeat(props || ' ', 300), 1, 2000) END AS error_message
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT * FROM j
"""
ORACLE["job_ledger_latest"] = JOBS
ORACLE["job_ledger_unfinished"] = JOBS + " WHERE status IN ('pending', 'processing')"
