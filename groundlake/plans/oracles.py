"""The queries of ``queries.py`` as SQL for DuckDB, written from the semantics, not from the plans."""

from __future__ import annotations

from ..functions.citations import CORRECTION
from ..functions.ids import ARCHIVES, CATEGORIES
from ..functions.prompts import ASK_CLOSED, ASK_RAG
from .inputs import ANSWERS_SQL, PAPERS_SQL

_P = "WITH" + PAPERS_SQL
_HITS = """
scored AS (SELECT q.vec_id AS qid, v.vec_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 8)"""
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_SNIPPET = f"substr(array_to_string({_WORDS}, ' '), 1, 320)"
_ID = r"^(\d{4}\.\d{4,5}|[a-z][a-z-]*(\.[A-Z]{2})?/\d{7}|inspire:\d+)(v\d+)?$"
_STRIP = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"


def _norm(x: str) -> str:
    return f"regexp_replace(lower({_STRIP % x}), 'v\\d+$', '')"


_CITED = f"""
cited AS (
  SELECT seq, list_sort(list_distinct(list_transform(list_filter(flatten(list_transform(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1), lambda x: regexp_split_to_array(x, '[,;]'))), lambda t: regexp_matches({_STRIP % "t"}, '{_ID}')), lambda t: {_norm("t")}))) AS cited FROM answers
)"""
_CANON = lambda c: f"list_sort(list_distinct(list_transform({c}, lambda t: {_norm('t')})))"
_VALID = f"""
base AS (SELECT a.*, c.cited, {_CANON("retrieved")} AS given, CASE WHEN expected IS NOT NULL THEN {_CANON("expected")} END AS wanted FROM answers a JOIN cited c USING (seq)),
sets AS (SELECT *, list_sort(list_filter(cited, lambda x: list_contains(given, x))) AS ok, list_sort(list_filter(cited, lambda x: NOT list_contains(given, x))) AS bad FROM base),
validated AS (
  SELECT *, len(bad) > 0 AS violation, len(cited) = 0 AS uncited,
    CASE WHEN len(wanted) > 0 THEN list_sort(list_filter(cited, lambda x: list_contains(wanted, x))) END AS cites,
    CASE WHEN len(wanted) > 0 THEN len(list_filter(given, lambda x: list_contains(wanted, x))) END AS n_found FROM sets
)"""
_A = "WITH" + ANSWERS_SQL + "," + _CITED + "," + _VALID
_RUN = """
run AS (
  SELECT seq, CAST(conv_id AS VARCHAR) AS qid, backend, condition, type, error, 'm' || (conv_id % 2) AS model, error IS NULL AS scored, violation, len(bad) AS n_invalid, bad, uncited,
    CASE WHEN len(wanted) > 0 THEN len(cites) / len(wanted) END AS cite_recall, CASE WHEN len(wanted) > 0 THEN n_found / len(wanted) END AS retr_recall, correctness, faithfulness,
    CASE WHEN type = 'out_of_corpus' THEN faithfulness END AS refusal_ok, CASE WHEN conv_id % 10 = 0 THEN 'see text' END AS notes FROM validated
)"""
_SUMMARY = """
summed AS (
  SELECT backend, condition, arg_min(model, seq) AS model, count(*) AS n_questions, count(*) FILTER (WHERE scored) AS n_scored, count(*) FILTER (WHERE error IS NOT NULL) AS n_errors,
    round(avg(CASE WHEN violation THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE scored), 3) AS grounding_violation_rate, round(avg(n_invalid) FILTER (WHERE scored), 3) AS mean_invalid_citations,
    round(avg(CASE WHEN uncited THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE scored), 3) AS uncited_answer_rate,
    round(avg(cite_recall) FILTER (WHERE scored AND type <> 'out_of_corpus'), 3) AS mean_expected_citation_recall, round(avg(retr_recall) FILTER (WHERE scored AND type <> 'out_of_corpus'), 3) AS mean_retrieval_recall,
    round(avg(correctness) FILTER (WHERE scored AND type <> 'out_of_corpus'), 3) AS mean_correctness, round(avg(faithfulness) FILTER (WHERE scored), 3) AS mean_faithfulness,
    round(avg(refusal_ok) FILTER (WHERE scored AND type = 'out_of_corpus'), 3) AS mean_refusal_ok
  FROM run GROUP BY backend, condition
)"""
_JOINED = """
joined AS (SELECT h.*, p.doc_id, p.paper_id, p.text, p.source, substr(p.published, 1, 4) AS year FROM hits h JOIN papers p ON p.doc_id = h.vec_id % (SELECT count(*) FROM documents))"""
_INDEX = """
idx AS (SELECT v.vec_id, p.doc_id, p.paper_id, p.title, p.published FROM embeddings v JOIN papers p ON p.doc_id = v.vec_id % (SELECT count(*) FROM documents))"""
_NORMAL = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'))"
#: Longest-matching-block ratios of ``pairs`` (pair, a, b). A block is the longest run of letters equal
#: on both sides, first in a, then in b; in a second text of 200 letters or more a run begins with
#: letters of at most a hundredth of it, and grows over the others. Left and right of it the same again.
_RATIO = """
side_a AS (SELECT pair, i, a[i] AS c FROM pairs, unnest(generate_series(1, length(a))) AS g(i)),
side_b AS (SELECT pair, j, c, length(b) >= 200 AND count(*) OVER (PARTITION BY pair, c) > length(b) // 100 + 1 AS popular FROM (SELECT pair, b, j, b[j] AS c FROM pairs, unnest(generate_series(1, length(b))) AS g(j))),
cells AS (SELECT x.pair, i, j, popular, i - row_number() OVER (PARTITION BY x.pair, i - j ORDER BY i) AS run, i - row_number() OVER (PARTITION BY x.pair, i - j, popular ORDER BY i) AS rare_run FROM side_a x JOIN side_b y ON x.pair = y.pair AND x.c = y.c),
lengths AS (SELECT pair, i, j, popular, i - min(i) OVER w AS before, max(i) OVER w - i + 1 AS after, max(i) OVER r - i + 1 AS rare FROM cells WINDOW w AS (PARTITION BY pair, i - j, run), r AS (PARTITION BY pair, i - j, popular, rare_run)),
seg AS (
  SELECT pair, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS size FROM pairs WHERE a <> '' AND b <> ''
  UNION ALL
  SELECT pair, p.alo, p.ahi, p.blo, p.bhi, p.size FROM (
    SELECT pair, unnest([{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'size': n}, {'alo': i + n, 'ahi': ahi, 'blo': j + n, 'bhi': bhi, 'size': 0}]) AS p FROM (
      SELECT t.*, l.i - least(l.before, l.i - alo, l.j - blo) AS i, l.j - least(l.before, l.i - alo, l.j - blo) AS j, least(l.before, l.i - alo, l.j - blo) + least(l.after, ahi - l.i, bhi - l.j) AS n
      FROM (
        SELECT seg.pair, alo, ahi, blo, bhi, min([-least(rare, ahi - i, bhi - j), i, j]) AS best
        FROM seg LEFT JOIN lengths ON lengths.pair = seg.pair AND i >= alo AND i < ahi AND j >= blo AND j < bhi AND NOT popular
        WHERE alo < ahi AND blo < bhi GROUP BY seg.pair, alo, ahi, blo, bhi
      ) t JOIN lengths l ON l.pair = t.pair AND l.i = coalesce(t.best[2], alo) AND l.j = coalesce(t.best[3], blo)
    )
  )
),
ratios AS (SELECT pair, CASE WHEN length(any_value(a)) + length(any_value(b)) = 0 THEN 1.0 ELSE 2 * coalesce(sum(size), 0) / (length(any_value(a)) + length(any_value(b)))::DOUBLE END AS ratio FROM pairs LEFT JOIN seg USING (pair) GROUP BY pair)"""
_CHUNKS = f"""
toks AS (SELECT *, {_WORDS} AS w FROM papers),
cnt AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 450 THEN 1 ELSE CAST(ceil((len(w) - 450) / 390.0) AS INTEGER) + 1 END AS n FROM toks),
chunks AS (
  SELECT replace(replace(paper_id, '/', '_'), ':', '_') || '_' || printf('%03d', i) AS chunk_id, paper_id, substr(published, 1, 4) AS year, primary_category, CAST(i AS INTEGER) AS chunk_idx, n AS n_chunks,
    array_to_string(w[i * 390 + 1 : i * 390 + 450], ' ') AS text
  FROM cnt, unnest(generate_series(0, n - 1)) AS t(i) WHERE n > 0
)"""
_STEMS = """
stems AS (
  SELECT *, CASE doc_id % 6 WHEN 0 THEN printf('00%05d', doc_id) WHEN 1 THEN printf('%07d', 8700000 + doc_id) WHEN 2 THEN 'BF0' || doc_id WHEN 3 THEN 'PhysRevD.' || doc_id
    WHEN 4 THEN '1-s2.0-' || printf('%016d', doc_id * 1234567) || '-main' ELSE '1-s2.0-' || doc_id || '-main' END AS stem FROM papers
)"""
_RANKS = """
own AS (SELECT vec_id AS qid, CAST(unnest([label, (label + 1) % 10]) AS VARCHAR) AS expected_id FROM embeddings WHERE vec_id % 50 = 0),
labelled AS (SELECT h.qid, CAST(e.label AS VARCHAR) AS paper_id, h.rank FROM hits h JOIN embeddings e USING (vec_id)),
ranks AS (SELECT o.qid, o.expected_id, CAST(min(l.rank) AS INTEGER) AS rank FROM own o LEFT JOIN labelled l ON l.qid = o.qid AND l.paper_id = o.expected_id GROUP BY ALL)"""
_PASSAGE = f"printf('--- Passage %d (sim=%.3f) ---' || chr(10) || 'Title: %s' || chr(10) || 'ID: %s (%s)' || chr(10) || 'Text:' || chr(10) || '%s' || chr(10), rank, score, source, paper_id, year, {_SNIPPET})"
_PASSAGES = f"passages AS (SELECT qid, string_agg({_PASSAGE}, chr(10) ORDER BY rank) AS passages FROM joined GROUP BY qid)"
_LIST = lambda values: ", ".join(f"'{v}'" for v in values)
_CORRECTION = "'" + CORRECTION.replace("'", "''") + "'"
_LEAD = "chr(92)"

ORACLES: dict[str, str] = {
    "topk_single": "SELECT v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0 ORDER BY list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 8",
    "topk_batch": f"WITH {_HITS} SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM hits",
    "topk_blocked": f"WITH {_HITS} SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM hits",
    "topk_pruned": f"WITH {_HITS} SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM hits",
    "retrieve_join": f"{_P}, {_HITS}, {_JOINED} SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, doc_id, paper_id, round(score, 6) AS score, {_SNIPPET} AS snippet FROM joined",
    "vec_normalize": "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1)) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM s) SELECT vec_id, round(e[1] / norm, 6) AS first, round(list_sum(list_transform(e, lambda x: (x / norm) * (x / norm))), 6) AS norm2 FROM n",
    "chunk_rows": f"{_P}, {_CHUNKS} SELECT * FROM chunks",
    "filter_min_words": f"SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS n_words FROM documents WHERE len({_WORDS}) >= 50",
    "text_cleanup": f"""
WITH r AS (SELECT page_id, ' ' || chr(9) || '[NO ' || {_LEAD} || 'title GIVEN] <cit.>' || replace(html, '>', '>' || chr(9) || ' ' || chr(10) || chr(10) || chr(10)) || ' ' || chr(10) AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\[NO\\s+\\\\[a-z]+\\s+GIVEN\\]', '', 'g'), '<cit\\.>', '[cite]', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM r""",
    "pdf_cleanup": """
WITH r AS (SELECT page_id, ' ' || chr(10) || replace(html, 'e', 'e-' || chr(10) || 'x  ' || chr(10) || chr(10) || chr(10) || chr(10)) AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '-\\n(\\w)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM r""",
    "latex_strip": r"""
WITH r AS (SELECT page_id, chr(10) || '5\% of % gone' || chr(10) || '\input{x}\begin{figure*}a' || chr(10) || 'b\end{figure*} t \begin{table}q\end{table}\include{y}' || url || page_id || html || '\bibliographystyle{p}\bibliography{refs}\begin{thebibliography}{9}' || chr(10) || 'z' || chr(10) || '\end{thebibliography} end' AS t FROM pages),
c AS (SELECT page_id, replace(regexp_replace(replace(t, '\%', chr(1)), '%[^\n]*', '', 'g'), chr(1), '\%') AS t FROM r),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '\\bibliography\{[^}]*\}', '', 'g'), '\\bibliographystyle\{[^}]*\}', '', 'g'), '(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}', '', 'g') AS t FROM c),
f AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)\\begin\{figure\*?\}.*?\\end\{figure\*?\}', '[FIGURE]', 'g'), '(?s)\\begin\{table\*?\}.*?\\end\{table\*?\}', '[TABLE]', 'g') AS t FROM b)
SELECT page_id, regexp_replace(regexp_replace(t, '\\input\{[^}]*\}', '', 'g'), '\\include\{[^}]*\}', '', 'g') AS body, true AS is_latex FROM f""",
    "snippet": f"{_P} SELECT doc_id, '**1. `0.500` · [' || paper_id || '](https://arxiv.org/abs/' || paper_id || ') (' || substr(published, 1, 4) || ')** — ' || source || '  ' || chr(10) || '> ' || {_SNIPPET} || '…' || chr(10) AS line FROM papers",
    "id_normalize": f"{_P} SELECT doc_id, lower(paper_id) AS canonical, paper_id AS bare, replace(replace(paper_id, '/', '_'), ':', '_') AS safe FROM papers",
    "id_shape": f"{_P}, t AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN upper(paper_id) WHEN 1 THEN ' ' || paper_id || 'v3 ' WHEN 2 THEN paper_id || 'x' ELSE paper_id END AS k FROM papers) SELECT doc_id, regexp_matches(trim(k), '{_ID}') AS is_id, paper_id NOT LIKE 'inspire:%' AS is_public FROM t",
    "valid_year": f"{_P} SELECT doc_id, published NOT LIKE '?%' AS good, false AS with_newline FROM papers",
    "year_from_id": f"""{_P}, y AS (SELECT doc_id, CASE WHEN paper_id LIKE 'inspire:%' THEN NULL WHEN paper_id LIKE '%/%' THEN substr(split_part(paper_id, '/', 2), 1, 2) ELSE substr(paper_id, 1, 2) END AS yy, substr(printf('%07d', doc_id * 9001 % 10000000), 1, 2) AS ff FROM papers)
SELECT doc_id, CASE WHEN CAST(yy AS INTEGER) > 50 THEN '19' || yy WHEN yy IS NOT NULL THEN '20' || yy END AS year, CASE WHEN CAST(ff AS INTEGER) > 50 THEN '19' ELSE '20' END || ff AS file_year FROM y""",
    "filter_author": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0",
    "author_contains": "SELECT doc_id FROM documents WHERE doc_id % 3 = 2",
    "filter_category": f"{_P} SELECT doc_id, primary_category FROM papers WHERE primary_category IN ({_LIST(CATEGORIES)}) OR split_part(primary_category, '.', 1) IN ({_LIST(ARCHIVES)})",
    "filter_reason_counts": f"{_P} SELECT CASE WHEN NOT list_contains(list_transform(authors, lambda a: trim(a)), 'Ann Author') THEN 'skipped_author' WHEN primary_category IN ({_LIST(CATEGORIES)}) OR split_part(primary_category, '.', 1) IN ({_LIST(ARCHIVES)}) THEN 'kept' ELSE 'skipped_category' END AS reason, count(*) AS n FROM papers GROUP BY 1",
    "filename_rules": f"""{_P}, {_STEMS},
item AS (SELECT stem, regexp_extract(stem, '^1-s2\\.0-(.+)-main$', 1) AS p FROM stems WHERE stem LIKE '1-s2.0-%')
SELECT stem, 'recid' AS kind, coalesce(nullif(ltrim(stem, '0'), ''), '0') AS key, 'inspire:' || coalesce(nullif(ltrim(stem, '0'), ''), '0') AS canonical FROM stems WHERE regexp_matches(stem, '^00\\d*$')
UNION ALL SELECT stem, 'report', substr(stem, 1, 2) || '-' || substr(stem, 3, 2) || '-' || substr(stem, 5), NULL FROM stems WHERE regexp_matches(stem, '^\\d{{7}}$')
UNION ALL SELECT stem, 'doi', CASE WHEN stem LIKE 'BF%' THEN '10.1007/' ELSE '10.1103/' END || stem, CASE WHEN stem LIKE 'BF%' THEN '10.1007/' ELSE '10.1103/' END || stem FROM stems WHERE regexp_matches(stem, '^BF\\d+$') OR stem LIKE 'PhysRev%'
UNION ALL SELECT stem, 'doi', '10.1016/' || substr(p, 1, 4) || '-' || substr(p, 5, 4) || '(' || substr(p, 9, 2) || ')' || substr(p, 11, 5) || '-' || substr(p, 16, 1), 'pii:' || p FROM item WHERE length(p) >= 16
UNION ALL SELECT stem, 'doi', x || p, 'pii:' || p FROM item, (VALUES ('10.1016/'), ('10.1006/')) AS v(x)""",
    "title_candidate": f"SELECT doc_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP % 'x'}), lambda x: length(x) > 10 AND x NOT LIKE '\\%%' ESCAPE '\\')[1], 1, 80) AS candidate FROM documents",
    "corpus_id": f"{_P} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN paper_id WHEN doc_id % 2 = 0 THEN 'inspire:' || doc_id ELSE 'pii:' || doc_id END AS corpus_id FROM papers",
    "identify_files": f"""{_P}, {_STEMS}
SELECT stem, CASE WHEN doc_id % 6 NOT IN (0, 2) OR doc_id = 0 THEN NULL WHEN doc_id % 4 = 0 THEN paper_id ELSE 'inspire:' || doc_id END AS paper_id,
  CASE WHEN doc_id % 6 = 0 AND doc_id > 0 THEN 'inspire:' || doc_id WHEN doc_id % 6 = 2 THEN '10.1007/' || stem END AS canonical FROM stems""",
    "extract_citations": f"WITH {ANSWERS_SQL}, {_CITED} SELECT * FROM cited",
    "outside_marker": f"WITH {ANSWERS_SQL} SELECT seq, regexp_matches(answer, '(?i)outside\\s+(the\\s+)?corpus') AS outside FROM answers",
    "validate_citations": f"""{_A} SELECT seq, CAST(len(cited) AS INTEGER) AS n_cited, ok AS valid_citations, bad AS invalid_citations, CAST(len(bad) AS INTEGER) AS n_invalid, violation AS grounding_violation, uncited, regexp_matches(answer, '(?i)outside\\s+(the\\s+)?corpus') AS marked_outside_corpus,
  wanted AS expected_ids, cites AS cites_expected, n_found > 0 AS retrieval_hit, round(CASE WHEN len(wanted) > 0 THEN len(cites) / len(wanted) END, 6) AS citation_recall, round(CASE WHEN len(wanted) > 0 THEN n_found / len(wanted) END, 6) AS retrieval_recall FROM validated""",
    "guardrail_prompt": f"{_A} SELECT seq, printf({_CORRECTION}, array_to_string(bad, ', '), CASE WHEN len(bad) = 1 THEN 'is' ELSE 'are' END, CASE WHEN len(retrieved) = 0 THEN '(none)' ELSE array_to_string(list_sort(list_distinct(retrieved)), ', ') END) AS correction FROM validated WHERE violation",
    "guardrail_loop": f"""{_A}, tried AS (SELECT conv_id, answer, violation, row_number() OVER (PARTITION BY conv_id ORDER BY turn, answer) AS attempt FROM validated),
ended AS (SELECT conv_id, min(attempt) FILTER (WHERE NOT violation AND attempt <= 3) AS good, count(*) AS n FROM tried GROUP BY conv_id),
last AS (SELECT conv_id, coalesce(good, least(n, 3)) AS attempt, good IS NOT NULL AS grounded, good IS NULL AND n < 3 AS ran_out FROM ended)
SELECT conv_id, md5(answer) AS answer_md5, grounded, CAST(attempt AS INTEGER) AS attempts, ran_out FROM last JOIN tried USING (conv_id, attempt)""",
    "guardrail_replay": f"{_A} SELECT conv_id, bool_or(NOT violation) AS grounded, coalesce(min(attempt) FILTER (WHERE NOT violation), max(attempt)) AS attempts FROM (SELECT *, turn // 2 + 1 AS attempt FROM validated) WHERE attempt <= 3 GROUP BY conv_id",
    "anti_existing": f"{_P} SELECT paper_id FROM papers WHERE doc_id % 4 = 1",
    "join_missing": "SELECT CASE WHEN doc_id % 3 <> 0 THEN 'found' ELSE 'no_src' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "fallback_chain": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'attached' WHEN doc_id % 2 = 0 THEN 'by_doi' WHEN doc_id % 5 = 0 THEN 'located' END AS label, CASE WHEN doc_id % 3 = 0 THEN 'https://x/' || doc_id WHEN doc_id % 2 = 0 THEN 'd' || doc_id WHEN doc_id % 5 = 0 THEN 'l' || doc_id END AS url FROM documents",
    "export_public": f"{_P}, {_INDEX} SELECT vec_id, paper_id FROM idx WHERE paper_id NOT LIKE 'inspire:%'",
    "export_semi": f"{_P}, {_CHUNKS}, {_INDEX} SELECT chunk_id FROM chunks WHERE paper_id IN (SELECT paper_id FROM idx WHERE paper_id NOT LIKE 'inspire:%')",
    "export_manifest": f"{_P}, {_INDEX} SELECT count(*) AS source_vectors, count(DISTINCT paper_id) AS source_papers, count(*) FILTER (WHERE pub) AS public_vectors, count(DISTINCT paper_id) FILTER (WHERE pub) AS public_papers, count(*) FILTER (WHERE NOT pub) AS excluded_vectors, count(DISTINCT paper_id) FILTER (WHERE NOT pub) AS excluded_papers FROM (SELECT *, paper_id NOT LIKE 'inspire:%' AS pub FROM idx)",
    "delta_append": f"{_P} SELECT paper_id, doc_id FROM papers",
    "dedup_papers": f"{_P}, {_INDEX} SELECT paper_id, arg_min(substr(published, 1, 4), vec_id) AS year, arg_min(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), vec_id) AS norm FROM idx GROUP BY paper_id",
    "expected_rank": f"WITH {_HITS}, {_RANKS} SELECT * FROM ranks",
    "recall_preview": f"WITH {_HITS}, {_RANKS}, r AS (SELECT qid, count(rank) AS hits, count(*) AS n FROM ranks GROUP BY qid) SELECT round(avg(hits / n), 6) AS mean_recall, count(*) AS questions, count(*) FILTER (WHERE hits < n) AS missed FROM r",
    "eval_fanout": "SELECT item_id AS qid, backend, condition, CAST(k AS INTEGER) AS k FROM benchmark, (VALUES ('alpha'), ('beta')) AS b(backend), (VALUES ('rag', 8), ('closed_book', 0)) AS c(condition, k)",
    "eval_summary": f"{_A}, {_RUN}, {_SUMMARY} SELECT * FROM summed",
    "eval_markdown": f"""{_A}, {_RUN}, {_SUMMARY} SELECT backend || '·' || condition AS run, '| ' || concat_ws(' | ', backend || '·' || condition, model, n_scored, """
    + ", ".join(f"coalesce(printf('%.2f', {c}), '—')" for c in ["grounding_violation_rate", "mean_invalid_citations", "uncited_answer_rate", "mean_retrieval_recall", "mean_expected_citation_recall", "mean_correctness", "mean_faithfulness", "mean_refusal_ok"])
    + ") || ' |' AS line FROM summed",
    "rag_vs_closed": f"{_A}, {_RUN}, {_SUMMARY} SELECT backend, max(n_scored) FILTER (WHERE condition = 'rag') AS rag, max(n_scored) FILTER (WHERE condition = 'closed_book') AS closed_book FROM summed GROUP BY backend",
    "failure_lines": f"""{_A}, {_RUN} SELECT seq, '- [' || backend || '·' || condition || '] ' || qid || ': ' || CASE WHEN error IS NOT NULL THEN 'ERROR ' || error ELSE concat_ws('; ', CASE WHEN violation THEN CASE WHEN condition = 'closed_book' THEN 'cited from memory' ELSE 'cited but not among the hits' END || ' [''' || array_to_string(bad, ''', ''') || ''']' END, CASE WHEN correctness < 2 THEN 'correctness=' || correctness END) || coalesce(' — ' || notes, '') END AS line,
  coalesce(scored AND violation, false) AS violation, coalesce(correctness, 9) AS correctness, CAST(CASE WHEN scored THEN n_invalid ELSE 0 END AS INTEGER) AS n_invalid FROM run WHERE error IS NOT NULL OR violation OR correctness < 2""",
    "format_passages": f"{_P}, {_HITS}, {_JOINED}, {_PASSAGES} SELECT * FROM passages",
    "prompt_rag": f"{_P}, {_HITS}, {_JOINED}, {_PASSAGES} SELECT qid, '<question>' || chr(10) || 'Q' || qid || chr(10) || '</question>' || chr(10) || chr(10) || '<passages>' || chr(10) || passages || chr(10) || '</passages>' || chr(10) || chr(10) || '{ASK_RAG}' AS prompt FROM passages",
    "prompt_closed": f"SELECT item_id, '<question>' || chr(10) || text || chr(10) || '</question>' || chr(10) || chr(10) || '{ASK_CLOSED}' AS prompt FROM benchmark",
    "title_norm": f"SELECT doc_id, trim(regexp_replace(lower({_LEAD} || 'alpha{{X}}-' || text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents",
    "split_year": """
SELECT doc_id, CASE WHEN y BETWEEN 1950 AND 2099 THEN source || '  in 1985, again  end' ELSE source || '  in , again (' || y || ') end' END AS title, CASE WHEN y BETWEEN 1950 AND 2099 THEN CAST(y AS VARCHAR) ELSE '1985' END AS year
FROM (SELECT doc_id, source, 1950 + doc_id % 200 AS y FROM documents)""",
    "health_counts": "SELECT *, index_rows = chunk_rows AS equal FROM (SELECT (SELECT count(*) FROM embeddings) AS index_rows, (SELECT count(*) FROM documents) AS chunk_rows)",
    "health_report": f"""{_P}, seen AS (SELECT 'once' AS seen, paper_id, title, published FROM papers UNION ALL SELECT 'twice', CASE WHEN paper_id LIKE 'inspire%' THEN '' ELSE paper_id END, title, published FROM papers, (VALUES (1), (2)) AS v(k)),
sums AS (SELECT seen, count(*) AS n, count(*) FILTER (WHERE paper_id = '') AS empty, min(title) FILTER (WHERE paper_id = '') AS empty_name, count(*) FILTER (WHERE published LIKE '?%') AS odd, min(paper_id || ' ' || substr(published, 1, 4)) FILTER (WHERE published LIKE '?%') AS odd_name, count(paper_id) - count(DISTINCT paper_id) AS again FROM seen GROUP BY seen)
SELECT seen, 'paper ids present' AS "check", CASE WHEN empty = 0 THEN 'OK' ELSE 'FAIL' END AS status, CASE WHEN empty = 0 THEN '' ELSE empty || ' rows, first ' || empty_name END AS detail FROM sums
UNION ALL SELECT seen, 'metadata years', CASE WHEN odd = 0 THEN 'OK' ELSE 'WARN' END, CASE WHEN odd = 0 THEN '' ELSE odd || ' rows, first ' || odd_name END FROM sums
UNION ALL SELECT seen, 'paper_id unique', CASE WHEN again = 0 THEN 'OK' WHEN seen = 'once' THEN 'FAIL' ELSE 'WARN' END, n || ' rows, ' || again || ' again' FROM sums""",
    "health_unique": "SELECT *, n_rows = n_ids AS is_unique FROM (SELECT count(*) + count(*) FILTER (WHERE doc_id % 10 = 0) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM documents)",
    "health_years": f"{_P} SELECT paper_id, substr(published, 1, 4) AS year, source AS title FROM papers WHERE published LIKE '?%' ORDER BY paper_id LIMIT 5",
    "pdf_method": f"SELECT doc_id, CASE WHEN n - 60 >= 150 THEN 'text' WHEN n >= 50 THEN 'ocr' ELSE 'failed' END AS method FROM (SELECT doc_id, len({_WORDS}) AS n FROM documents)",
    "embed_hash": f"""WITH said AS (SELECT doc_id, unnest({_WORDS.replace("text", "lower(text)")}) AS w FROM documents),
bits AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM said)),
hashed AS (SELECT w, xor(list_reduce(list_concat([4294967295], flatten(list_transform(generate_series(1, len(x) - 1, 2), lambda i: [16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS h FROM bits),
cells AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM said JOIN hashed USING (w) GROUP BY ALL),
every AS (SELECT doc_id, g.i, coalesce(v, 0) AS v FROM documents CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS i) g LEFT JOIN cells USING (doc_id, i))
SELECT doc_id, 64 AS dim, CASE WHEN count(*) FILTER (WHERE v <> 0) > 0 THEN 1.0 ELSE 0.0 END AS norm2, arg_min(i, -v * 100 + i) AS largest, md5(string_agg(CASE WHEN v > 0 THEN '+' WHEN v < 0 THEN '-' ELSE '0' END, '' ORDER BY i)) AS signs FROM every GROUP BY doc_id""",
    "rejects_shown": f"{_P} SELECT paper_id, CASE WHEN doc_id % 2 = 0 THEN substr(published, 1, 4) END AS year FROM papers ORDER BY coalesce(year, '9999'), paper_id LIMIT 15",
    "join_metadata": f"{_P} SELECT replace(replace(paper_id, '/', '_'), ':', '_') AS safe, n_chars AS length, paper_id || 'v2' AS paper_id, published FROM papers WHERE doc_id % 3 = 0",
    "api_rows": f"{_P} SELECT paper_id, source AS title, 'a ' || source AS abstract, published, primary_category FROM papers",
    "catalogue_papers": f"""{_P}, e AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND paper_id NOT LIKE 'inspire:%' THEN paper_id END AS ep FROM papers),
y AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '1984' WHEN ep IS NULL THEN '????' WHEN CAST(substr(ep, 1, 2) AS INTEGER) > 50 THEN '19' || substr(ep, 1, 2) ELSE '20' || substr(ep, 1, 2) END AS year FROM e)
SELECT coalesce(ep, 'inspire:' || doc_id) AS paper_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS title, CASE WHEN doc_id % 5 > 0 THEN ['A', ''] ELSE CAST([] AS VARCHAR[]) END AS authors, year || '-01-01T00:00:00' AS published,
  CASE WHEN ep IS NOT NULL AND doc_id % 4 = 0 THEN primary_category ELSE 'hep-th' END AS primary_category, 'https://arxiv.org/pdf/' || ep AS pdf_url, CASE WHEN doc_id % 7 = 0 THEN 'J' END AS journal_ref FROM y""",
    "without_eprint": f"{_P} SELECT doc_id FROM papers WHERE doc_id % 2 = 1 OR paper_id LIKE 'inspire:%'",
    "main_tex": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_LEAD} || 'documentclass{{a}}' || source || '3' ELSE source || '2' END AS main FROM documents",
    "query_prefix": "SELECT item_id, 'Represent this sentence for searching relevant passages: ' || text AS question FROM benchmark",
    "year_adjust": """WITH r AS (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS ratio, CASE WHEN doc_id % 3 > 0 THEN 1976 + doc_id % 25 END AS wanted, CASE WHEN doc_id % 11 > 0 THEN 1976 + doc_id % 50 END AS year FROM documents),
s AS (SELECT doc_id, round(least(1.0::DOUBLE, ratio + CASE WHEN wanted IS NULL OR year IS NULL THEN 0.0 WHEN wanted = year THEN 0.05 ELSE -0.05 END), 3) AS score FROM r)
SELECT *, CASE WHEN score >= 0.9 THEN 'confident' WHEN score >= 0.6 THEN 'review' ELSE 'none' END AS band FROM s""",
    "open_access": "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'https://x/' || doc_id END AS listed, 'https://x/' || doc_id AS best FROM documents",
    "title_similarity": f"""{_P.replace("WITH", "WITH RECURSIVE", 1)}, normal AS (SELECT doc_id, {_NORMAL} AS t FROM papers),
pairs AS (SELECT x.doc_id AS pair, x.t AS a, y.t AS b FROM normal x JOIN normal y ON y.doc_id = x.doc_id + 1), {_RATIO}
SELECT pair AS doc_id, round(ratio, 6) AS similarity FROM ratios""",
    "resolve_titles": f"""{_P.replace("WITH", "WITH RECURSIVE", 1)}, {_INDEX},
known AS (SELECT paper_id, {_NORMAL} AS t, title, year FROM (SELECT paper_id, arg_min(title, vec_id) AS title, arg_min(substr(published, 1, 4), vec_id) AS year FROM idx GROUP BY paper_id)),
asked AS (SELECT CAST(doc_id AS VARCHAR) AS qid, {_NORMAL} AS t, CASE WHEN published NOT LIKE '?%' THEN substr(published, 1, 4) END AS year FROM (SELECT doc_id, published, title || CASE WHEN published LIKE '?%' THEN ' (????)' ELSE '' END AS title FROM papers WHERE doc_id % 50 = 0)),
texts AS (SELECT q.t AS a, k.t AS b, row_number() OVER () AS pair FROM (SELECT DISTINCT t FROM asked) q, (SELECT DISTINCT t FROM known) k),
pairs AS (SELECT pair, a, b FROM texts), {_RATIO},
met AS (
  SELECT qid, paper_id, title, known.year, least(1.0::DOUBLE, ratio + CASE WHEN asked.year IS NULL OR known.year IS NULL OR known.year = '' THEN 0.0 WHEN asked.year = known.year THEN 0.05 ELSE -0.05 END) AS s
  FROM asked JOIN texts ON texts.a = asked.t JOIN ratios USING (pair) JOIN known ON known.t = texts.b
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, paper_id) AS INTEGER) AS rank FROM met)
SELECT qid, rank, paper_id, title, year, round(s, 3) AS score, CASE WHEN round(s, 3) >= 0.9 THEN 'confident' WHEN round(s, 3) >= 0.6 THEN 'review' ELSE 'none' END AS band FROM ranked WHERE rank <= 3""",
}
