"""The registered queries in DuckDB SQL, built of named common table expressions."""

from __future__ import annotations

import re

from ..functions import relevance as R
from ..functions import text as T
from ..operators.enrich import PROMPT
from . import views

_S = r"[ \t\n\r\f\x0B]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rx(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {_q(pattern)}, {_q(to)}, 'g')"


def trim_ws(c: str) -> str:
    return _rx(c, f"^{_S}+|{_S}+$", "")


def strip_marks(c: str) -> str:
    return _rx(c, "^[ :-]+|[ :-]+$", "")


def norm_id(c: str) -> str:
    w = r"[\p{L}\p{N}_]+"
    c = _rx(trim_ws(c), f"{_S}+", " ")
    c = _rx(_rx(c, r"\s*:\s*", ": "), r"(IS\s*[0-9]+)\(", r"\1 (")
    c = _rx(c, rf"\(\s*(?i:part)\s*({w})\s*/\s*(?i:sec)\s*({w})\s*\)", r"(Part \1/Sec \2)")
    c = _rx(c, rf"\(\s*(?i:part)\s*({w})\s*\)", r"(Part \1)")
    for numeral, n in T.ROMAN.items():
        c = _rx(c, rf"\(Part (?i:{numeral})(\)|/Sec )", rf"(Part {n}\1")
        c = _rx(c, rf"(\(Part {w}/Sec )(?i:{numeral})\)", rf"\g1{n})".replace(r"\g1", r"\1"))
    return c


def is_toc(c: str) -> str:
    return f"(length({c}) > {T.TITLE_LENGTH} OR regexp_matches({c}, '[0-9]+\\.[0-9]+\\s+IS\\s+[0-9]+'))"


def clean_title(c: str) -> str:
    return strip_marks(_rx(c, rf"{_S}+[0-9]+(\.[0-9]+)?{_S}*$", ""))


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def sentences(c: str) -> str:
    cut = f"string_split(regexp_replace({c}, '([.!?]){_S}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter([{trim_ws('s')} for s in {cut}], lambda s: length(s) >= {T.MIN_SENTENCE})"


def prefix(sid: str, title: str, category: str) -> str:
    return f"'Standard: ' || {sid} || CASE WHEN coalesce({title}, '') <> '' THEN ' -- ' || {title} ELSE '' END || CASE WHEN coalesce({category}, '') <> '' THEN ' [Category: ' || {category} || ']' ELSE '' END || '. '"


def _num(c: str, pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, {_q(pattern)}, 1), '') AS INTEGER)"


def part_of_id(c: str) -> str:
    return f"coalesce({_num(c, r'(?i)part[\s-]?([0-9]+)')}, {_num(trim_ws(c), r'-([0-9]+)$')})"


def part_of_query(c: str) -> str:
    roman = f"lower(regexp_extract({c}, '(?i)part[\\s-]?(iv|iii|ii|i)\\b', 1))"
    return f"coalesce({_num(c, r'(?i)part[\s-]?([0-9]+)')}, CASE {roman} WHEN 'i' THEN 1 WHEN 'ii' THEN 2 WHEN 'iii' THEN 3 WHEN 'iv' THEN 4 END)"


def eval_id(c: str) -> str:
    return f"regexp_replace(lower(replace({c}, ' ', '')), ':[0-9]{{4}}$', '')"


def _words(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def norm_query(c: str) -> str:
    return _rx(f"lower({trim_ws(c)})", f"{_S}+", " ")


def query_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{_S}+'), lambda w: w <> '')"


def has_any(c: str, words: list[str]) -> str:
    return f"list_has_any({query_tokens(c)}, {_words(words)})"


def greeting(c: str) -> str:
    return f"(lower({trim_ws(_rx(c, '[!?.,' + chr(39) + chr(34) + ']+$', ''))}) IN ({_words(R.GREETINGS)[1:-1]}))"


def bare(c: str) -> str:
    return trim_ws(_rx(f"lower({trim_ws(c)})", "[!?.,'\"]+$", ""))


def mixed(c: str) -> str:
    return f"({has_any(c, R.CONNECTORS)} AND {has_any(c, R.INTENTS)})"


def numbered(c: str) -> str:
    return f"regexp_matches({c}, '(?i)\\bis[\\s:\u2013-]?[0-9]{{2,5}}\\b')"


def fallback(sid: str, title: str, text: str) -> str:
    snippet = trim_ws(f"substring(coalesce({text}, ''), 1, 120)")
    return f"'Found for this query: ' || coalesce({sid}, '') || ' [' || coalesce({title}, '') || '] ' || {snippet}"


def fences(c: str) -> str:
    return _rx(_rx(trim_ws(c), f"^```json{_S}*", ""), f"{_S}*```$", "")


def _vectors(key: str, text: str, rows: str) -> str:
    """``key, v``: the hashed token counts of a text, of length one."""
    counts = f"SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS dim, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {key}, unnest({tokens(text)}) AS term FROM {rows}) GROUP BY ALL"
    places = f"SELECT {key}, unnest(range(64)) AS dim FROM {rows}"
    return f"SELECT {key}, list(x / greatest(norm, 1e-9) ORDER BY dim) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {key})) AS norm FROM (SELECT {key}, dim, coalesce(n, 0.0) AS x FROM ({places}) LEFT JOIN ({counts}) USING ({key}, dim))) GROUP BY {key}"


_RELEVANT = f"(coalesce(NOT ({bare('query')} IN ({_words(R.GREETINGS)[1:-1]})) AND {has_any(bare('query'), R.HINTS)}, false))"
_FALLBACK_MESSAGE = f"CASE WHEN {bare('query')} IN ({_words(R.GREETINGS)[1:-1]}) THEN {_q(R.GREETED)} WHEN {has_any(bare('query'), R.HINTS)} THEN '' ELSE {_q(R.REJECTED)} END"
_HEAD = T.HEADING.replace("(?:", "(?:")

CTES = {
    "chunks_raw": views.CHUNKS_RAW,
    "queries": views.QUERIES,
    "result_rows": views.RESULTS,
    "results": "SELECT seq, query_id, latency_seconds, [expected] AS exp, list(retrieved ORDER BY rank, retrieved) AS ret FROM result_rows GROUP BY seq, query_id, expected, latency_seconds",
    "lines": f"SELECT doc_id, line_no, CAST(line_no // 40 AS INTEGER) + 1 AS page, {views.LINE} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)",
    "found_ids": f"SELECT *, regexp_extract(text, '(?i)\\b({_HEAD})\\b', 1) AS raw_id FROM lines",
    "placed_ids": "SELECT *, CASE WHEN raw_id = '' THEN -1 ELSE strpos(text, raw_id) - 1 END AS id_start, CASE WHEN raw_id = '' THEN '' ELSE substring(text, strpos(text, raw_id) + length(raw_id)) END AS tail FROM found_ids",
    "headings": f"SELECT *, id_start BETWEEN 0 AND 10 AND length(text) <= 160 AND ({trim_ws('tail')} = '' OR regexp_matches({trim_ws('tail')}, '[A-Za-z]{{2,}}')) AND NOT regexp_matches(lower({trim_ws('tail')}), {_q('|'.join(T.CITATIONS))}) AS is_heading FROM placed_ids",
    "segmented": "SELECT * FROM (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM headings) WHERE segment > 0",
    "heads": f"SELECT doc_id, segment, line_no AS seq, page, raw_id, CASE WHEN length(t) > 3 THEN t END AS named FROM (SELECT *, {clean_title(strip_marks('tail'))} AS t FROM segmented WHERE is_heading)",
    "title_lines": "SELECT s.doc_id, s.segment, min(s.line_no) AS title_no, arg_min(s.text, s.line_no) AS title_text FROM segmented s JOIN heads h USING (doc_id, segment) WHERE NOT s.is_heading AND h.named IS NULL AND length(s.text) < 120 AND s.text NOT LIKE '%.' GROUP BY ALL",
    "bodies": "SELECT s.doc_id, s.segment, string_agg(s.text, ' ' ORDER BY s.line_no) AS body FROM segmented s LEFT JOIN title_lines t USING (doc_id, segment) WHERE NOT s.is_heading AND (t.title_no IS NULL OR s.line_no <> t.title_no) GROUP BY ALL",
    "segments": f"SELECT doc_id, CAST(seq AS BIGINT) AS seq, {norm_id('raw_id')} AS standard_id, CASE WHEN {is_toc('title')} THEN '' ELSE coalesce(title, '') END AS title, {trim_ws('txt')} AS text, page AS page_number FROM (SELECT h.*, coalesce(named, title_text) AS title, raw_id || CASE WHEN coalesce(named, title_text, '') <> '' THEN ' -- ' || coalesce(named, title_text) ELSE '' END || chr(10) || body AS txt FROM heads h JOIN bodies USING (doc_id, segment) LEFT JOIN title_lines USING (doc_id, segment))",
    "records": f"SELECT * FROM (SELECT seq, {norm_id('standard_id')} AS standard_id, {clean_title('CASE WHEN ' + is_toc('title') + chr(32) + 'THEN ' + chr(39) * 2 + ' ELSE title END')} AS title, {trim_ws('text')} AS text, page_number, coalesce(category, '') AS category, source FROM chunks_raw) WHERE length(text) >= 50",
    "longest": "SELECT * FROM (SELECT *, min(seq) OVER (PARTITION BY standard_id) AS first_seq, row_number() OVER (PARTITION BY standard_id ORDER BY length(text) DESC, seq) AS n FROM records) WHERE n = 1",
    "parents": "SELECT * FROM longest WHERE length(text) >= 50",
    "record_windows": f"SELECT *, unnest(range(0, len(s), 2)) // 2 AS window_no FROM (SELECT *, {sentences('text')} AS s FROM records)",
    "parent_windows": f"SELECT *, unnest(range(0, len(s), 2)) // 2 AS window_no FROM (SELECT *, {sentences('text')} AS s FROM parents)",
    "children": f"SELECT *, {prefix('standard_id', 'title', 'category')} || raw_window AS full_text FROM (SELECT *, array_to_string(s[2 * window_no + 1 : 2 * window_no + 4], ' ') AS raw_window FROM parent_windows)",
    "doc_tokens": f"SELECT doc_id AS chunk_id, {tokens('text')} AS t FROM documents",
    "postings": "SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM doc_tokens) GROUP BY chunk_id, term",
    "dfs": "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "stats": "SELECT count(*) AS n_docs, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM doc_tokens",
    "raw_idf": "SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats",
    "idf": "SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf",
    "bench_terms": f"SELECT query_id, term, count(*) AS qtf FROM (SELECT 'B-' || item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL",
    "scores": "SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM postings JOIN bench_terms USING (term) JOIN idf USING (term), stats GROUP BY ALL",
    "asked": f"SELECT query_id, query FROM queries WHERE {_RELEVANT}",
    "rejected": f"SELECT query_id, query, {_FALLBACK_MESSAGE} AS message FROM queries WHERE NOT {_RELEVANT}",
    "asked_terms": f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM asked) GROUP BY ALL",
    "chunk_tokens": f"SELECT seq AS chunk_id, {tokens('text')} AS t FROM records",
    "chunk_postings": "SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM chunk_tokens) GROUP BY chunk_id, term",
    "chunk_stats": "SELECT count(*) AS n_docs, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM chunk_tokens",
    "chunk_raw_idf": "SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM chunk_postings GROUP BY term), chunk_stats",
    "chunk_idf": "SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM chunk_raw_idf) ELSE raw END AS idf FROM chunk_raw_idf",
    "sparse": "SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM chunk_postings JOIN asked_terms USING (term) JOIN chunk_idf USING (term), chunk_stats GROUP BY ALL)) WHERE rank <= 10",
    "chunk_vectors": _vectors("seq", "text", "records"),
    "query_vectors": _vectors("query_id", "query", "asked"),
    "dense": "SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT query_id, seq AS chunk_id, list_inner_product(q.v, c.v) AS score FROM query_vectors q, chunk_vectors c)) WHERE rank <= 10",
    "fused": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rrf_rank FROM (SELECT query_id, chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS rrf_score FROM dense d FULL JOIN sparse s USING (query_id, chunk_id))",
    "candidates": f"SELECT query_id, chunk_id, rrf_rank, standard_id, title, page_number, text, {part_of_id('standard_id')} AS part_number FROM fused JOIN records ON chunk_id = seq WHERE rrf_rank <= 10",
    "prioritised": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN want IS NULL OR part_number = want THEN 0 WHEN part_number IS NULL THEN 1 ELSE 2 END, rrf_rank) AS rank FROM (SELECT c.*, query, {part_of_query('query')} AS want FROM candidates c JOIN asked USING (query_id))",
    "reranked": f"SELECT query_id, chunk_id, standard_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank) AS rank FROM (SELECT p.*, coalesce(CAST(len(list_intersect(list_distinct({tokens('query')}), {tokens('coalesce(f.text, p.text)')})) AS DOUBLE) / nullif(len(list_distinct({tokens('query')})), 0), 0) AS s FROM prioritised p LEFT JOIN parents f USING (standard_id))",
    "deduped": "SELECT * EXCLUDE (rank, n), n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, standard_id ORDER BY rank) AS k FROM prioritised) WHERE k = 1) WHERE n <= 5",
    "hydrated": "SELECT d.query_id, d.rank, d.standard_id, CASE WHEN p.seq IS NULL THEN d.title ELSE p.title END AS title, CASE WHEN p.seq IS NULL THEN d.text ELSE p.text END AS text, CASE WHEN p.seq IS NULL THEN d.page_number ELSE p.page_number END AS page_number FROM deduped d LEFT JOIN parents p USING (standard_id)",
    "blocks": "SELECT query_id, string_agg('- ' || standard_id || ': ' || coalesce(title, ''), chr(10) ORDER BY rank) AS standards_block FROM hydrated GROUP BY query_id",
    "listed": "SELECT query_id, string_agg(standard_id, '|' ORDER BY rank) AS retrieved FROM hydrated GROUP BY query_id",
    "batch": "SELECT query_id, coalesce(retrieved, '') AS retrieved, '' AS message FROM asked LEFT JOIN listed USING (query_id) UNION ALL SELECT query_id, '', message FROM rejected",
    "answers": f"SELECT query_id, rank, standard_id, title, page_number, {fallback('standard_id', 'title', 'text')} AS rationale FROM hydrated",
    "golden": f"SELECT query_id, [{eval_id('x')} for x in ids] AS e, CASE WHEN retrieved = '' THEN [] ELSE [{eval_id('x')} for x in string_split(retrieved, '|')] END AS r FROM batch JOIN (SELECT 'B-' || item_id AS query_id, list(DISTINCT standard_id) AS ids FROM benchmark b JOIN records d ON contains(d.text, b.text) GROUP BY ALL) USING (query_id)",
    "hits": f"SELECT *, [{eval_id('x')} for x in exp] AS e, [{eval_id('x')} for x in ret] AS r FROM results",
    "ranks": "SELECT query_id, latency_seconds, list_has_any(r[1:3], e) AS hit, coalesce(1.0 / list_min(list_filter(range(1, least(len(r), 5) + 1), lambda i: list_contains(e, r[i]))), 0) AS rr FROM hits",
    "metrics": "SELECT count(*) AS total, 100 * avg(CAST(hit AS INTEGER)) AS hit_rate_3, avg(rr) AS mrr_5, avg(coalesce(latency_seconds, 0)) AS avg_latency FROM ranks HAVING count(*) > 0",
    "dictionary": "SELECT * FROM (VALUES ('expansion', 'opc', 'Ordinary Cement'), ('expansion', 'ppc', 'Portland Pozzolana Cement'), ('expansion', 'is', 'Indian Standard'), ('expansion', 'fly ash', 'FA'), ('expansion', 'the', 'the said'), ('expansion', 'opc 43 fly ash', 'OPC with FA'), ('expansion', 'ash', 'residue'), ('expansion', 'tmt', 'thermo mechanically treated'), ('expansion', 'tmt bars', 'thermo mechanically treated'), ('expansion', 'thha', '[last] of two'), ('expansion', 'an', 'an {object}'), ('spelling', 'cemnt', 'cement'), ('spelling', 'cemant', 'cement'), ('spelling', 'stel', 'steel')) t(kind, key, value)",
    "spellings": "SELECT MAP(list(key), list(value)) AS m FROM dictionary WHERE kind = 'spelling'",
    "expansions": "SELECT MAP(list(key), list(value)) AS m FROM dictionary WHERE kind = 'expansion'",
    "corrected": f"SELECT query_id, query, norm, [coalesce(m[w], w) for w in {query_tokens('norm')}] AS t FROM (SELECT query_id, query, {norm_query('query')} AS norm FROM queries), spellings",
}


def _expand(source: str) -> str:
    """Greedy expansion as a recursive query: a row a step of each query of ``source(query_id, t)``."""
    grams = []
    for n in (4, 3, 2, 1):
        guard = "" if n > 1 else " AND (g1 <> 'is' OR regexp_matches(coalesce(t[i + 2], ''), '^[0-9]+$'))"
        grams.append((n, f"(i + {n} <= len(t) AND m[g{n}] IS NOT NULL{guard})"))
    step = " ".join(f"WHEN {c} THEN {n}" for n, c in grams)
    value = " ".join(f"WHEN {c} THEN m[g{n}]" for n, c in grams)
    names = ", ".join(f"lower(array_to_string(t[i + 1 : i + {n}], ' ')) AS g{n}" for n in (4, 3, 2, 1))
    return f"""expanded AS (
  SELECT query_id, t, 0 AS i, CAST([] AS VARCHAR[]) AS o FROM {source}
  UNION ALL
  SELECT query_id, t, i + CASE {step} ELSE 1 END, list_append(o, CASE {value} ELSE t[i + 1] END)
  FROM (SELECT *, {names} FROM expanded, expansions WHERE i < len(t))
), final AS (SELECT query_id, array_to_string(o, ' ') AS value FROM expanded WHERE i >= len(t))"""


def _with(select: str, extra: str = "") -> str:
    """``select`` with the expressions that it needs, directly or through others, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(select + " " + extra)
    parts = [f"{n} AS ({CTES[n]})" for n in needed] + ([extra] if extra else [])
    return (f"WITH {'RECURSIVE ' if extra else ''}" + ",\n".join(parts) + "\n" if parts else "") + select


def _value(f: str) -> str:
    return f"SELECT query_id, {f} AS value FROM queries"


_QUERIES = {
    "pages_to_lines": f"SELECT * FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS page_line, {trim_ws('unnest(string_split(text, chr(10)))')} AS text FROM documents) WHERE text <> ''",
    "read_chunks": "SELECT standard_id, title, md5(text) AS text_md5, page_number, category, source FROM chunks_raw",
    "write_chunks": "SELECT standard_id, title, md5(text) AS text_md5, (SELECT count(*) FROM children c WHERE c.standard_id = p.standard_id) AS n_children FROM parents p",
    "read_queries": "SELECT query_id, query FROM queries",
    "write_results": "SELECT query_id AS id, exp[1] AS expected, array_to_string(ret, '|') AS retrieved, round(latency_seconds, 8) AS latency FROM results",
    "read_dictionary": f"SELECT kind, key, value, coalesce(n_docs, 0) AS n_docs FROM dictionary LEFT JOIN (SELECT key, count(*) AS n_docs FROM (SELECT unnest(list_distinct({tokens('text')})) AS key FROM documents) GROUP BY key) USING (key)",
    "normalize_standard_id": f"SELECT seq, {norm_id('standard_id')} AS standard_id FROM chunks_raw",
    "is_toc_title": f"SELECT seq, {is_toc('title')} AS is_toc FROM chunks_raw",
    "clean_title_suffix": f"SELECT seq, {clean_title('title')} AS title FROM chunks_raw",
    "detect_headings": "SELECT doc_id, line_no, raw_id, id_start, is_heading FROM headings",
    "filter_min_content": f"SELECT doc_id, n_chars FROM documents WHERE length({trim_ws('text')}) >= 50",
    "split_sentences": f"SELECT doc_id, unnest(range(len(s))) AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "context_prefix": f"SELECT seq, {prefix('standard_id', 'title', 'category')} AS prefix FROM chunks_raw",
    "tokenize": "SELECT chunk_id AS doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM doc_tokens",
    "extract_part_number": f"SELECT seq, {part_of_id('standard_id')} AS part FROM records",
    "extract_query_part": f"SELECT query_id, {part_of_query('query')} AS part FROM queries",
    "normalize_eval_id": f"SELECT seq, rank, {eval_id('retrieved')} AS id FROM result_rows",
    "segment_lines": "SELECT * FROM segments",
    "dedup_keep_longest": "SELECT standard_id, seq, first_seq, title, md5(text) AS text_md5 FROM parents",
    "dedup_report": "SELECT (SELECT count(*) FROM records) AS n_raw, count(*) AS n_unique, count(*) FILTER (length(text) >= 50) AS n_valid, count(*) FILTER (length(text) < 50) AS n_dropped FROM longest",
    "create_child_chunks": f"SELECT seq, window_no, {prefix('standard_id', 'title', 'category')} || array_to_string(s[2 * window_no + 1 : 2 * window_no + 4], ' ') AS text FROM record_windows",
    "prepare_corpus": "SELECT standard_id, window_no, title, category, page_number, raw_window FROM children",
    "select_index_chunks": "SELECT standard_id, count(*) AS n, CAST(sum(length(full_text)) AS BIGINT) AS n_chars FROM children GROUP BY standard_id",
    "normalize_query": _value(norm_query("query")),
    "is_greeting": _value(greeting("query")),
    "is_mixed_language": _value(mixed("query")),
    "has_standard_number": _value(numbered(norm_query("query"))),
    "has_domain_hint": _value(has_any("query", R.HINTS)),
    "add_query_prefix": _value(f"{_q(R.QUERY_PREFIX)} || query"),
    "fix_spellings": f"SELECT query_id, array_to_string([coalesce(m[w], w) for w in {query_tokens('query')}], ' ') AS value FROM queries, spellings",
    "relevance_fallback": f"SELECT query_id, {_RELEVANT} AS is_relevant, CASE WHEN {_RELEVANT} THEN query ELSE '' END AS search_query, {_FALLBACK_MESSAGE} AS message FROM queries",
    "parse_expansion_response": f"""SELECT query_id, CASE k WHEN 0 THEN true WHEN 3 THEN true WHEN 2 THEN fb ELSE false END AS is_relevant,
  CASE k WHEN 0 THEN 'more' WHEN 3 THEN query WHEN 2 THEN CASE WHEN fb THEN query ELSE '' END ELSE '' END AS search_query,
  CASE k WHEN 1 THEN 'no' WHEN 2 THEN fm WHEN 4 THEN {_q(R.REJECTED)} ELSE '' END AS message
FROM (SELECT *, length(query) % 5 AS k, {_RELEVANT} AS fb, {_FALLBACK_MESSAGE} AS fm FROM queries)""",
    "term_frequencies": "SELECT * FROM postings",
    "document_frequencies": "SELECT * FROM dfs",
    "corpus_stats": "SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_idf": "SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf FROM raw_idf",
    "encode_text": "SELECT chunk_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)), 6) AS x FROM (SELECT chunk_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS dim, CAST(sum(tf) AS DOUBLE) AS n FROM postings GROUP BY ALL)",
    "bm25_scores": "SELECT query_id, chunk_id, round(score, 6) AS score FROM scores",
    "sparse_top_k": "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores) WHERE rank <= 10",
    "dense_top_k": "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10",
    "l2_normalize": "SELECT vec_id AS chunk_id, unnest(range(len(e))) AS dim, round(unnest([x / greatest(sqrt(list_inner_product(e, e)), 1e-9) for x in e]), 6) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    "rrf_fusion": "SELECT query_id, chunk_id, rrf_rank, round(rrf_score, 6) AS rrf_score FROM fused",
    "build_candidates": "SELECT query_id, chunk_id, rrf_rank, standard_id, title, page_number, part_number FROM candidates",
    "part_priority": "SELECT query_id, chunk_id, standard_id, rank FROM prioritised",
    "rerank": "SELECT query_id, chunk_id, standard_id, rank FROM reranked WHERE rank <= 10",
    "dedup_results": "SELECT query_id, chunk_id, standard_id, rank FROM deduped",
    "hydrate_parents": "SELECT query_id, rank, standard_id, title, md5(text) AS text_md5, page_number FROM hydrated",
    "retrieve": "SELECT query_id, rank, standard_id, title, md5(text) AS text_md5, page_number FROM hydrated",
    "batch_retrieve": "SELECT * FROM batch",
    "recommend_stream": "SELECT * FROM batch",
    "fallback_rationale": f"SELECT seq, {fallback('standard_id', 'title', 'text')} AS rationale FROM chunks_raw",
    "standards_block": "SELECT * FROM blocks",
    "build_prompts": f"SELECT query_id, replace(replace({_q(PROMPT)}, '{{query}}', query), '{{standards_block}}', standards_block) AS prompt FROM blocks JOIN asked USING (query_id)",
    "parse_rationale_response": "SELECT seq AS query_id, seq % 4 IN (0, 3) AS is_valid, CASE seq % 4 WHEN 0 THEN 'A=later' WHEN 3 THEN 'B=' || category ELSE '' END AS rationales FROM chunks_raw",
    "merge_rationales": "SELECT query_id, rank, standard_id, CASE WHEN rank = 1 AND ascii(right(query_id, 1)) % 2 = 0 THEN 'because' ELSE rationale END AS rationale FROM answers",
    "generate_rationales": "SELECT query_id, rank, standard_id, rationale FROM answers",
    "format_response": "SELECT query_id, rank, standard_id, coalesce(title, '') AS title, coalesce(page_number, 0) AS page_number, rationale FROM answers",
    "recommend": "SELECT query_id, rank, standard_id, coalesce(title, '') AS title, coalesce(page_number, 0) AS page_number, rationale, '' AS message FROM answers UNION ALL SELECT query_id, NULL, NULL, NULL, NULL, NULL, message FROM rejected",
    "golden_set": "SELECT count(*) AS total, round(100 * avg(CAST(list_has_any(r[1:3], e) AS INTEGER)), 6) AS hit_rate_3, round(avg(coalesce(1.0 / list_min(list_filter(range(1, least(len(r), 5) + 1), lambda i: list_contains(e, r[i]))), 0)), 6) AS mrr_5 FROM golden HAVING count(*) > 0",
    "hit_at_k": "SELECT query_id, hit FROM ranks",
    "reciprocal_rank": "SELECT query_id, round(rr, 6) AS rr FROM ranks",
    "evaluate_results": "SELECT total, round(hit_rate_3, 6) AS hit_rate_3, round(mrr_5, 6) AS mrr_5, round(avg_latency, 6) AS avg_latency FROM metrics",
    "latency_summary": "SELECT round(coalesce(avg(round(latency_seconds, 3)), 0), 3) AS steady_latency FROM results WHERE seq > 0",
    "meets_targets": "SELECT hit_rate_3 > 80 AS hit_rate_ok, mrr_5 > 0.7 AS mrr_ok, avg_latency < 5 AS latency_ok FROM metrics",
}

ORACLE_SQL = {name: _with(sql) for name, sql in _QUERIES.items()}
CTES["window_tokens"] = f"SELECT standard_id, window_no, {tokens('full_text')} AS t FROM children"
ORACLE_SQL["build_index"] = _with(
    "SELECT term, df, tf, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf FROM (SELECT term, df, tf, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM "
    "(SELECT term, count(*) AS df, CAST(sum(c) AS BIGINT) AS tf FROM (SELECT standard_id, window_no, term, count(*) AS c FROM (SELECT standard_id, window_no, unnest(t) AS term FROM window_tokens) GROUP BY ALL) GROUP BY term), "
    "(SELECT count(*) AS n FROM window_tokens))"
)
CTES["plain_tokens"] = f"SELECT query_id, {query_tokens('query')} AS t FROM queries"
ORACLE_SQL["expand_abbreviations"] = _with("SELECT query_id, value FROM final", _expand("plain_tokens"))
_reason = f"CASE WHEN {greeting('query')} THEN 'greeting' WHEN {mixed('norm')} THEN 'mixed language' WHEN {numbered('norm')} THEN 'number' WHEN {has_any('norm', R.HINTS)} THEN 'keyword' WHEN value <> norm THEN 'expansion' ELSE 'rejected' END"
ORACLE_SQL["classify_queries"] = _with(
    f"SELECT query_id, ok AS is_relevant, reason, CASE WHEN ok THEN norm ELSE '' END AS primary_query, CASE WHEN ok THEN value ELSE '' END AS expanded_query, ok AND value <> norm AS has_expansions, "
    f"CASE reason WHEN 'greeting' THEN {_q(R.GREETED)} WHEN 'rejected' THEN {_q(R.REJECTED)} ELSE '' END AS message "
    f"FROM (SELECT *, reason NOT IN ('greeting', 'rejected') AS ok FROM (SELECT *, {_reason} AS reason FROM corrected JOIN final USING (query_id)))",
    _expand("corrected"),
)
