"""SQL of the registered queries for the comparison engine, built from shared common table expressions."""

from __future__ import annotations


_LINES = "src AS (SELECT doc_id, CAST(unnest(range(len(x))) AS BIGINT) AS ln, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"

_WORDS = f"""{_LINES},
w0 AS (SELECT doc_id, ln, CAST(unnest(range(len(x))) AS BIGINT) AS wo, unnest(x) AS word, CASE WHEN doc_id % 3 = 0 THEN 44 ELSE 88 END AS cap
       FROM (SELECT doc_id, ln, string_split(line, ' ') AS x FROM src)),
w1 AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, ln ORDER BY wo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cs FROM w0),
w2 AS (SELECT *, cs // cap AS tl, cs % cap AS cc, length(word) >= 8 AND (cs % cap) + length(word) > cap AS cut FROM w1),
w3 AS (SELECT doc_id, ln, wo, CASE WHEN cut THEN substr(word, 1, 4) || '-' ELSE word END AS text, 2 * wo AS wo2, tl, cc FROM w2
       UNION ALL SELECT doc_id, ln, wo, substr(word, 5), 2 * wo + 1, tl + 1, 0 FROM w2 WHERE cut),
w4 AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS nc, dense_rank() OVER (PARTITION BY doc_id ORDER BY ln, tl) - 1 AS g FROM w3),
w5 AS (SELECT *, g // (30 * nc) AS page_index, (g % (30 * nc)) // 30 AS col, g % 30 AS "row", tl = 0 AND ln % 10 = 5 AS heading FROM w4),
w6 AS (SELECT *, sum(CASE WHEN tl = 0 AND ln % 4 = 0 AND ln > 0 AND wo2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index, col ORDER BY g) AS opened,
       CASE WHEN nc = 2 THEN 150 + 740 * col ELSE 180 END AS cl, CASE WHEN nc = 2 THEN 660 ELSE 1340 END AS cw,
       CASE WHEN tl = 0 AND ln % 4 <> 0 AND ln > 0 THEN 60 ELSE 0 END AS indent FROM w5),
w7 AS (SELECT *, cl + least(15 * cc + indent, cw - 15) AS l FROM w6),
margin AS (SELECT doc_id, CAST(unnest(range(CAST(last AS BIGINT) + 1)) AS BIGINT) AS page_index FROM (SELECT doc_id, max(page_index) AS last FROM w5 GROUP BY doc_id)),
words AS (
  SELECT doc_id, page_index, g * 100000 + wo2 AS word_ord, text, l, 240 + 46 * "row" + 30 * opened AS t, least(15 * length(text), cl + cw - l) AS w,
         CASE WHEN g = 0 THEN 60 WHEN heading THEN 48 ELSE 40 END AS h, 30 + (13 * length(text) + 7 * wo) % 70 AS confidence,
         100000 * (col + 1) + CASE WHEN g = 0 THEN 0 WHEN heading THEN 2 ELSE 1 END AS block_num, CASE WHEN heading THEN ln ELSE ln // 4 END AS par_num, g AS line_num,
         length(text) % 9 = 0 AS is_bold, length(text) % 11 = 0 AS is_italic, CASE WHEN length(text) % 9 = 0 THEN 6.0 ELSE 4.0 END::DOUBLE AS stroke FROM w7
  UNION ALL SELECT doc_id, page_index, -1, 'Libro ' || doc_id, 180, 60, 15 * length('Libro ' || doc_id), 20, 95, 1, 0, 0, false, false, 4.0 FROM margin
  UNION ALL SELECT doc_id, page_index, 900000000001, '' || (page_index + 1), 180, 2110, 15 * length('' || (page_index + 1)), 20, 95, 600002, 0, 0, false, false, 4.0 FROM margin
  UNION ALL SELECT doc_id, page_index, 900000000000, '1 Nota al pie ' || page_index, 180, 1960, 15 * length('1 Nota al pie ' || page_index), 28, 95, 600001, 0, 0, false, false, 4.0
            FROM margin WHERE (doc_id + page_index) % 2 = 0)"""

_LAID = f"""{_WORDS},
lines AS (SELECT doc_id, page_index, block_num, par_num, line_num, min(word_ord) AS line_ord, string_agg(text, ' ' ORDER BY word_ord) AS text, min(l) AS l, min(t) AS t, max(l + w) AS r,
          max(t + h) AS b, avg(confidence) AS confidence, count(*) AS n_words FROM words GROUP BY ALL)"""
_LAID = _LAID.replace("GROUP BY ALL)", "GROUP BY doc_id, page_index, block_num, par_num, line_num HAVING trim(string_agg(text, ' ' ORDER BY word_ord)) <> '')")

_PAGE_NUMBER = "length(trim({0}, ' .-—–')) <= 7 AND regexp_matches(trim({0}, ' .-—–'), '^(?i:[ivxlcdm]{{1,7}})$|^[0-9]{{1,4}}$')"
_ZONED = f"""{_LAID},
zoned AS (SELECT *, CASE WHEN {_PAGE_NUMBER.format("text")} AND ((t + b) / 2 <= 2200 * 0.05::DOUBLE OR (t + b) / 2 >= 2200 * (1 - 0.08::DOUBLE)) THEN 'page_number'
          WHEN (t + b) / 2 <= 2200 * 0.05::DOUBLE THEN 'header' WHEN (t + b) / 2 >= 2200 * (1 - 0.08::DOUBLE) THEN 'footer' ELSE 'body' END AS zone FROM lines)"""

_PARTED = f"""{_ZONED},
blocks AS (SELECT doc_id, page_index, zone, block_num, par_num, min(line_ord) AS block_ord, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, avg(b - t) AS line_height,
           arg_min(text, line_ord) AS first_text, count(*) AS n_lines FROM zoned GROUP BY doc_id, page_index, zone, block_num, par_num),
mids AS (SELECT doc_id, page_index, median(line_height) AS m FROM blocks WHERE zone = 'body' GROUP BY doc_id, page_index),
parted AS (SELECT k.*, CASE WHEN zone = 'body' AND (t + b) / 2 >= 2200 * (1 - 0.28::DOUBLE) AND (t + b) / 2 < 2200 * (1 - 0.08::DOUBLE)
             AND ((m > 0 AND line_height <= m * 0.82::DOUBLE) OR regexp_matches(trim(first_text), '^([0-9]{{1,3}}[.)]?\\s|\\*\\s|[¹²³⁴⁵⁶⁷⁸⁹])')) THEN 'footnote' ELSE zone END AS zone2
           FROM blocks k LEFT JOIN mids USING (doc_id, page_index))"""

_RANGES = f"""{_PARTED},
boxes AS (SELECT doc_id, page_index, greatest(l, 0) AS l, least(r, 1700) AS r, block_ord FROM parted WHERE zone2 = 'body'),
reach AS (SELECT *, max(r) OVER (PARTITION BY doc_id, page_index ORDER BY l, r, block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM boxes WHERE r > l),
runs_ AS (SELECT *, sum(CASE WHEN p IS NULL OR l - p >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY l, r, block_ord) AS run FROM reach),
found AS (SELECT doc_id, page_index, min(l) AS l, max(r) AS r FROM runs_ GROUP BY doc_id, page_index, run HAVING max(r) - min(l) >= 85),
good AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_index) AS n, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY l) - 1 AS i FROM found),
ranges AS (SELECT doc_id, page_index, i, l, r FROM good WHERE n <= 4
           UNION ALL SELECT DISTINCT doc_id, page_index, 0, 0, 1700 FROM boxes WHERE (doc_id, page_index) NOT IN (SELECT (doc_id, page_index) FROM good WHERE n <= 4))"""

_ORDERED = f"""{_RANGES},
total AS (SELECT doc_id, page_index, max(r) - min(l) AS total, count(*) AS n FROM ranges GROUP BY doc_id, page_index),
flow AS (SELECT * FROM parted WHERE zone2 = 'body'),
flow_mid AS (SELECT doc_id, page_index, median(line_height) AS fm FROM flow GROUP BY doc_id, page_index),
choice AS (SELECT f.doc_id, f.page_index, f.zone, f.block_num, f.par_num,
             arg_min(g.i, CASE WHEN (f.l + f.r) / 2 BETWEEN g.l AND g.r THEN g.i - 1000000 ELSE least(abs((f.l + f.r) / 2 - g.l), abs((f.l + f.r) / 2 - g.r)) + g.i * 1e-6 END) AS i
           FROM flow f JOIN ranges g ON f.doc_id = g.doc_id AND f.page_index = g.page_index GROUP BY ALL),
typed AS (SELECT p.doc_id, p.page_index, p.zone, p.block_num, p.par_num, p.block_ord, p.l, p.t, p.r, p.b, p.zone2 = 'body' AS is_flow,
            CASE WHEN zone2 <> 'body' THEN zone2 WHEN fm > 0 AND line_height >= fm * 1.4::DOUBLE AND t <= 2200 * 0.2::DOUBLE THEN 'title' WHEN fm > 0 AND line_height >= fm * 1.15::DOUBLE THEN 'heading' ELSE 'body_text' END AS type,
            CASE WHEN zone2 <> 'body' THEN 0 WHEN n > 1 AND p.r - p.l >= 0.7::DOUBLE * total THEN -1 ELSE i END AS column_index
          FROM parted p LEFT JOIN total USING (doc_id, page_index) LEFT JOIN flow_mid USING (doc_id, page_index) LEFT JOIN choice USING (doc_id, page_index, zone, block_num, par_num)),
banded AS (SELECT *, is_flow AND column_index = -1 AS spans,
             CASE WHEN NOT is_flow THEN 0 WHEN column_index = -1 THEN coalesce(sum(CASE WHEN is_flow AND column_index = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY t, block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             ELSE sum(CASE WHEN is_flow AND column_index = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY t) END AS band FROM typed),
regions AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE WHEN type = 'header' THEN 0 WHEN is_flow THEN 1 WHEN type = 'footnote' THEN 2 ELSE 3 END, band, spans,
              CASE WHEN is_flow AND NOT spans THEN column_index ELSE 0 END, t, type = 'page_number', block_ord) - 1 AS reading_order FROM banded)"""

_LIST = "(regexp_matches({0}, '^[•∙◦‣·*-]\\s+') OR regexp_matches({0}, '^([0-9]{{1,3}}|[a-zA-Z]|[ivxlcdm]{{1,6}})[.)]\\s+'))"


def _paragraphs(source: str) -> str:
    key = "PARTITION BY doc_id, page_index, zone, block_num, par_num"
    return f"""
gaps AS (SELECT *, t - lag(b) OVER ({key} ORDER BY line_ord) AS gap FROM {source}),
marks AS (SELECT doc_id, page_index, zone, block_num, par_num, median(l)::DOUBLE AS baseline_left, coalesce(median(b - t), 20.0)::DOUBLE * 0.55::DOUBLE * 1.8::DOUBLE AS indent_threshold,
          coalesce(median(gap) FILTER (WHERE gap > 0), 0)::DOUBLE AS typical FROM gaps GROUP BY doc_id, page_index, zone, block_num, par_num),
paras AS (SELECT g.*, baseline_left, indent_threshold, sum(CASE WHEN gap IS NULL THEN 0 WHEN l - baseline_left > indent_threshold OR (typical > 0 AND gap > typical * 1.6::DOUBLE) OR {_LIST.format("ltrim(text)")}
          THEN 1 ELSE 0 END) OVER ({key.replace("doc_id,", "g.doc_id,")} ORDER BY line_ord) AS para FROM gaps g JOIN marks USING (doc_id, page_index, zone, block_num, par_num))"""


def _runs(source: str, keys: str, name: str = "styled") -> str:
    return f"""
follow AS (SELECT *, lead(text) OVER (PARTITION BY {keys} ORDER BY word_ord) AS following, lead(line_ord) OVER (PARTITION BY {keys} ORDER BY word_ord) AS next_line,
           coalesce(is_bold <> lag(is_bold) OVER (PARTITION BY {keys} ORDER BY word_ord) OR is_italic <> lag(is_italic) OVER (PARTITION BY {keys} ORDER BY word_ord), false) AS changed FROM {source}),
tokens AS (SELECT *, CASE WHEN following IS NULL THEN text WHEN next_line <> line_ord AND regexp_matches(text, '\\p{{L}}-$') AND regexp_matches(following, '^\\p{{Ll}}') THEN left(text, length(text) - 1)
           ELSE text || ' ' END AS token, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY word_ord) AS run FROM follow),
{name} AS (SELECT {keys}, run, string_agg(token, '' ORDER BY word_ord) AS text, bool_or(is_bold) AS bold, bool_or(is_italic) AS italic FROM tokens GROUP BY {keys}, run)"""


_ENDS = "(rtrim({0}) = '' OR regexp_matches(rtrim({0}), '[.?!:;»”\"''\\)\\]]$'))"
_LINE_BLOCKS = f"""{_LINES}, lb AS (SELECT doc_id, ln AS block_ordinal, line, CASE WHEN ln % 7 = 3 THEN 'title' WHEN ln % 5 IN (1, 2) THEN 'list_item' ELSE 'paragraph' END AS type, ln % 2 = 0 AS list_ordered FROM src)"""
_BATCHED = f"""{_LINES}, real AS (SELECT doc_id, ln, line, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k FROM src WHERE trim(line) <> ''),
batched AS (SELECT doc_id, ln, line, k, CAST(0 AS BIGINT) AS batch_id, CAST(0 AS BIGINT) AS local_i, CAST(n AS BIGINT) AS used FROM real WHERE k = 1
  UNION ALL SELECT r.doc_id, r.ln, r.line, r.k, CASE WHEN b.used + r.n > 3000 THEN b.batch_id + 1 ELSE b.batch_id END, CASE WHEN b.used + r.n > 3000 THEN 0 ELSE b.local_i + 1 END,
    CASE WHEN b.used + r.n > 3000 THEN r.n ELSE b.used + r.n END FROM batched b JOIN real r ON r.doc_id = b.doc_id AND r.k = b.k + 1)"""
_LATEST = "latest AS (SELECT user_id AS job_id, max(event_id) AS seq, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id)"

ORACLES: dict[str, str] = {
    "paragraph_merge": f"""WITH {_LINES}, o AS (SELECT *, CASE WHEN coalesce({_ENDS.format("lag(line) OVER (PARTITION BY doc_id ORDER BY ln)")}, true) THEN 1 ELSE 0 END AS opens FROM src),
        p AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS para FROM o)
        SELECT doc_id, para::BIGINT AS para, string_agg(line, ' ' ORDER BY ln) AS text, count(*) AS n_lines FROM p GROUP BY doc_id, para""",
    "sentence_end_stats": f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {_ENDS.format('line')}) AS n_ends FROM src GROUP BY doc_id",
    "text_layer_detect": """SELECT source, count(*) AS n, avg(CASE WHEN length(replace(trim(text), chr(10), '')) >= 20 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share,
        avg(CASE WHEN length(replace(trim(text), chr(10), '')) >= 20 THEN 1.0 ELSE 0.0 END) >= 0.6 AS has_text_layer FROM documents GROUP BY source""",
    "blank_line_paragraphs": f"""WITH {_LINES} SELECT doc_id, (ln // 2)::BIGINT AS para, string_agg(line, ' ' ORDER BY ln) AS text FROM src GROUP BY doc_id, ln // 2""",
    "list_item_classify": f"""WITH {_LINES}, k AS (SELECT *, regexp_matches(ltrim(line), '^[•∙◦‣·*-]\\s+') AS is_bullet, {_LIST.format("ltrim(line)")} AS is_list FROM src)
        SELECT doc_id, ln, line, is_bullet, NOT is_bullet AS is_numbered FROM k WHERE is_list""",
    "page_number_detect": f"""WITH {_LINES}, w AS (SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM src) SELECT doc_id, word, count(*) AS n FROM w WHERE {_PAGE_NUMBER.format("word")} GROUP BY doc_id, word""",
    "footnote_marker_extract": f"""WITH {_LINES}, m AS (SELECT doc_id, ln, (ln % 1200) || CASE ln % 3 WHEN 0 THEN '. ' WHEN 1 THEN ') ' ELSE '' END || line AS line FROM src)
        SELECT doc_id, ln, regexp_matches(trim(line), '^([0-9]{{1,3}}[.)]?\\s|\\*\\s|[¹²³⁴⁵⁶⁷⁸⁹])') AS looks, nullif(regexp_extract(line, '^([0-9]{{1,3}})[.)]?\\s+', 1), '') AS marker,
        regexp_replace(line, '^([0-9]{{1,3}})[.)]?\\s+', '') AS rest FROM m""",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""",
    "words_confidence_filter": f"WITH {_WORDS} SELECT doc_id, count(*) AS n_words, sum(confidence)::BIGINT AS sum_confidence, min(confidence)::BIGINT AS min_confidence FROM words WHERE trim(text) <> '' AND confidence >= 40 GROUP BY doc_id",
    "words_to_lines": f"WITH {_LAID} SELECT doc_id, page_index, block_num, par_num, line_num, line_ord, text, l, t::BIGINT AS t, r, b::BIGINT AS b, round(confidence, 6) AS confidence, n_words FROM lines",
    "page_full_text": f"WITH {_LAID} SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY line_ord) AS full_text FROM lines GROUP BY doc_id, page_index",
    "margin_split": f"WITH {_ZONED} SELECT doc_id, page_index, line_ord, zone FROM zoned",
    "footnote_split": f"WITH {_PARTED} SELECT doc_id, page_index, block_num, par_num, zone, zone2, round(line_height, 6) AS line_height, n_lines FROM parted",
    "column_ranges": f"WITH {_RANGES} SELECT doc_id, page_index, i::BIGINT AS i, l::BIGINT AS l, r::BIGINT AS r FROM ranges",
    "reading_order": f"WITH {_ORDERED} SELECT doc_id, page_index, block_num, par_num, zone, type, column_index::BIGINT AS column_index, reading_order, l, t::BIGINT AS t, r, b::BIGINT AS b FROM regions",
    "split_paragraphs": f"WITH {_ZONED}, body AS (SELECT * FROM zoned WHERE zone = 'body'),{_paragraphs('body')} SELECT doc_id, page_index, block_num, par_num, line_num, para::BIGINT AS para, round(indent_threshold, 6) AS indent_threshold, baseline_left FROM paras",
    "style_runs": f"WITH {_WORDS}, wl AS (SELECT *, line_num AS line_ord FROM words),{_runs('wl', 'doc_id, page_index, block_num, par_num')} SELECT doc_id, page_index, block_num, par_num, run::BIGINT AS run, text, bold, italic FROM styled",
    "bold_vs_block_median": f"""WITH {_WORDS}, m AS (SELECT doc_id, page_index, block_num, median(stroke) FILTER (WHERE stroke > 0) AS m FROM words GROUP BY doc_id, page_index, block_num)
        SELECT doc_id, page_index, block_num, count(*) AS n, count(*) FILTER (WHERE m > 1e-6 AND stroke > 0 AND stroke / m >= 1.25) AS n_bold FROM words JOIN m USING (doc_id, page_index, block_num) GROUP BY doc_id, page_index, block_num""",
    "dominant_style": f"WITH {_WORDS} SELECT doc_id, page_index, block_num, par_num, count(*) FILTER (WHERE is_bold) * 2 > count(*) AS bold, count(*) FILTER (WHERE is_italic) * 2 > count(*) AS italic FROM words GROUP BY doc_id, page_index, block_num, par_num",
    "infer_title": f"""WITH {_ORDERED}, tl AS (SELECT doc_id, page_index, reading_order, string_agg(z.text, ' ' ORDER BY z.line_ord) AS text
          FROM regions g JOIN zoned z USING (doc_id, page_index, zone, block_num, par_num) WHERE g.type = 'title' GROUP BY doc_id, page_index, reading_order),
        f AS (SELECT doc_id, arg_min(text, page_index * 100000 + reading_order) AS title FROM tl GROUP BY doc_id)
        SELECT DISTINCT r.doc_id, coalesce(title, '') AS title FROM regions r LEFT JOIN f USING (doc_id) WHERE r.type IN ('title', 'heading', 'body_text', 'footnote')""",
    "list_islands": f"""WITH {_LINE_BLOCKS}, o AS (SELECT *, CASE WHEN type = 'list_item' AND coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY block_ordinal) = 'list_item', false) THEN 0 ELSE 1 END AS opens FROM lb),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY block_ordinal) AS island FROM o)
        SELECT doc_id, block_ordinal, type, island::BIGINT AS island, row_number() OVER (PARTITION BY doc_id, island ORDER BY block_ordinal) AS item,
        first_value(list_ordered) OVER (PARTITION BY doc_id, island ORDER BY block_ordinal) AS island_ordered FROM i""",
    "chapters": f"""WITH {_LINE_BLOCKS}, n AS (SELECT *, count(*) FILTER (WHERE type = 'title') OVER (PARTITION BY doc_id ORDER BY block_ordinal) AS n FROM lb)
        SELECT doc_id, block_ordinal, n - first_value(n) OVER (PARTITION BY doc_id ORDER BY block_ordinal) + 1 AS chapter,
        CASE WHEN n = 0 THEN 'Documento' ELSE first_value(line) OVER (PARTITION BY doc_id, n ORDER BY block_ordinal) END AS chapter_title FROM n""",
    "translation_batches": f"WITH RECURSIVE {_BATCHED} SELECT doc_id, ln AS block_ordinal, batch_id, local_i FROM batched",
    "translation_prompts": f"""WITH RECURSIVE {_BATCHED} SELECT doc_id, batch_id, 'Translate into ''en''.' || chr(10) || chr(10) || string_agg('<<<BLOCK_' || local_i || '>>>' || chr(10) || line || chr(10) || '<<<END_' || local_i || '>>>', chr(10) ORDER BY local_i) AS prompt,
        greatest(1024, sum(length(line)) // 2)::BIGINT AS max_tokens FROM batched GROUP BY doc_id, batch_id""",
    "translation_apply": f"""WITH {_LINES} SELECT doc_id, ln AS block_ordinal, CASE WHEN trim(line) <> '' AND ln % 3 <> 2 THEN trim(upper(substr(line, 1, 1)) || ' of block ' || ln) ELSE line END AS text, trim(line) <> '' AND ln % 3 <> 2 AS is_translated FROM src""",
    "language_sample": f"WITH {_LINES} SELECT doc_id, substr(string_agg(line, ' ' ORDER BY ln), 1, 4000) AS sample FROM src WHERE trim(line) <> '' GROUP BY doc_id",
    "lang_code_lookup": """WITH c AS (SELECT ['eng', 'spa', 'fra', 'deu', 'ita', 'por', 'nld', 'rus', 'chi_sim', 'chi_tra', 'jpn', 'kor', 'ara', 'xxx'] AS c),
        t(code, named, short) AS (VALUES ('eng', 'en', 'en'), ('spa', 'es', 'es'), ('fra', 'fr', 'fr'), ('deu', 'german', 'de'), ('ita', 'it', 'it'), ('por', 'pt', 'pt'), ('nld', 'nl', 'nl'),
            ('rus', 'ru', 'ru'), ('chi_sim', 'ch', 'ch_sim'), ('chi_tra', 'chinese_cht', 'ch_tra'), ('jpn', 'japan', 'ja'), ('kor', 'korean', 'ko'), ('ara', 'ar', 'ar')),
        k AS (SELECT c[doc_id % 14 + 1] AS code, c[doc_id % 5 + 1] AS other FROM documents, c)
        SELECT k.code, k.other, count(*) AS n, coalesce(any_value(a.named), 'en') AS named,
        CASE WHEN coalesce(any_value(a.short), 'en') = any_value(b.short) THEN any_value(b.short) ELSE coalesce(any_value(a.short), 'en') || ',' || any_value(b.short) END AS short
        FROM k LEFT JOIN t a ON a.code = k.code LEFT JOIN t b ON b.code = k.other GROUP BY k.code, k.other""",
    "quad_boxes": """WITH q AS (SELECT l_orderkey, l_linenumber, l_extendedprice % 1500 AS x, l_quantity * 20 AS y FROM lineitem WHERE (1 - l_discount) * 100 - 50 >= 40.5)
        SELECT l_orderkey, l_linenumber, trunc(x - 0.5)::BIGINT AS l, trunc(y)::BIGINT AS t, trunc((x + 30.5) - (x - 0.5))::BIGINT AS w, trunc((y + 12.5) - y)::BIGINT AS h FROM q""",
    "job_latest_status": f"WITH {_LATEST} SELECT * FROM latest",
    "job_history_topk": f"WITH {_LATEST} SELECT * FROM latest ORDER BY ts DESC, job_id DESC LIMIT 100",
    "job_formats": "SELECT o_orderkey, 2::BIGINT AS n, substr(o_orderpriority, 1, 1) AS second FROM orders",
    "indent_words": f"""WITH {_LAID}, m AS (SELECT doc_id, page_index, median(l) AS m FROM lines GROUP BY doc_id, page_index)
        SELECT doc_id, page_index, line_num, block_num, string_split(text, ' ')[1] AS word FROM lines JOIN m USING (doc_id, page_index) WHERE l > m""",
}

_KEYS = "doc_id, page_index, zone, block_num, par_num, para"
_PLACE = "page_index, reading_order, para"
_MERGED = f"""{_ORDERED},
column_mid AS (SELECT doc_id, page_index, column_index, median(l)::DOUBLE AS column_left FROM regions WHERE type = 'body_text' GROUP BY doc_id, page_index, column_index),
held AS (SELECT z.*, g.type, g.reading_order, g.r AS region_right, m.column_left FROM zoned z JOIN regions g USING (doc_id, page_index, zone, block_num, par_num)
         LEFT JOIN column_mid m ON m.doc_id = g.doc_id AND m.page_index = g.page_index AND m.column_index = g.column_index WHERE g.type IN ('title', 'heading', 'body_text', 'footnote')),
{_paragraphs("held")},
own AS (SELECT * REPLACE (CASE WHEN type = 'body_text' THEN para ELSE 0 END AS para) FROM paras),
kw AS (SELECT w.*, p.zone, p.para, p.line_ord FROM words w JOIN own p USING (doc_id, page_index, block_num, par_num, line_num)),
{_runs("kw", _KEYS)},
style AS (SELECT {_KEYS}, count(*) FILTER (WHERE is_bold) * 2 > count(*) AS bold, count(*) FILTER (WHERE is_italic) * 2 > count(*) AS italic FROM kw GROUP BY {_KEYS}),
part AS (SELECT {_KEYS}, type, reading_order, any_value(column_left) AS column_left, any_value(region_right) AS region_right, any_value(baseline_left) AS baseline_left, any_value(indent_threshold) AS thr,
         arg_min(text, line_ord) AS first_text, arg_min(l, line_ord) AS first_left, median(l)::DOUBLE AS pl, median(r)::DOUBLE AS pr, count(*) AS n, string_agg(text, ' ' ORDER BY line_ord) AS joined
         FROM own GROUP BY {_KEYS}, type, reading_order),
kind AS (SELECT *, CASE WHEN type <> 'body_text' THEN type WHEN {_LIST.format("ltrim(first_text)")} THEN 'list_item'
           WHEN n > 1 AND pl - coalesce(column_left, baseline_left) > thr * 1.8::DOUBLE AND region_right - pr > thr THEN 'quote' ELSE 'paragraph' END AS kind,
           type = 'body_text' AND regexp_matches(ltrim(first_text), '^([0-9]{{1,3}}|[a-zA-Z]|[ivxlcdm]{{1,6}})[.)]\\s+') AS list_ordered, type = 'body_text' AND first_left - baseline_left > thr AS indented FROM part),
prun AS (SELECT k.doc_id, k.page_index, k.reading_order, k.para, run, s.text AS raw, CASE WHEN kind = 'footnote' AND run = 0 THEN regexp_replace(s.text, '^([0-9]{{1,3}})[.)]?\\s+', '') ELSE s.text END AS text, s.bold, s.italic
         FROM kind k JOIN styled s USING ({_KEYS}) WHERE type NOT IN ('title', 'heading')
         UNION ALL SELECT k.doc_id, k.page_index, k.reading_order, k.para, 0, joined, joined, s.bold, s.italic FROM kind k JOIN style s USING ({_KEYS}) WHERE type IN ('title', 'heading')),
ptext AS (SELECT doc_id, {_PLACE}, string_agg(text, '' ORDER BY run) AS text, arg_min(raw, run) AS raw FROM prun GROUP BY doc_id, {_PLACE}),
opened AS (SELECT k.*, p.raw, CASE WHEN kind = 'paragraph' AND lag(kind) OVER o = 'paragraph' AND NOT {_ENDS.format("lag(p.text) OVER o")} THEN 0 ELSE 1 END AS opens
           FROM kind k JOIN ptext p USING (doc_id, {_PLACE}) WINDOW o AS (PARTITION BY doc_id ORDER BY page_index, reading_order, para)),
numbered AS (SELECT *, (sum(opens) OVER (PARTITION BY doc_id ORDER BY page_index, reading_order, para) - 1)::BIGINT AS block_ordinal FROM opened),
mrun AS (SELECT r.doc_id, block_ordinal, r.page_index, r.reading_order, r.para, run, bold, italic, text || CASE WHEN lead(block_ordinal) OVER o = block_ordinal AND lead(r.reading_order * 1000000 + r.para + r.page_index * 1000000000) OVER o <> r.reading_order * 1000000 + r.para + r.page_index * 1000000000 THEN ' ' ELSE '' END AS text,
         CASE WHEN lag(bold) OVER q = bold AND lag(italic) OVER q = italic THEN 0 ELSE 1 END AS changed
         FROM prun r JOIN numbered n USING (doc_id, {_PLACE}) WINDOW o AS (PARTITION BY r.doc_id ORDER BY r.page_index, r.reading_order, r.para, run), q AS (PARTITION BY r.doc_id, block_ordinal ORDER BY r.page_index, r.reading_order, r.para, run)),
isl AS (SELECT *, sum(changed) OVER (PARTITION BY doc_id, block_ordinal ORDER BY page_index, reading_order, para, run) AS i FROM mrun),
final_run AS (SELECT doc_id, block_ordinal, i, string_agg(text, '' ORDER BY page_index, reading_order, para, run) AS text, bool_or(bold) AS bold, bool_or(italic) AS italic FROM isl GROUP BY doc_id, block_ordinal, i),
joined_run AS (SELECT doc_id, block_ordinal, string_agg(text, '' ORDER BY i) AS text,
    string_agg(CASE WHEN bold AND italic THEN '***' || text || '***' WHEN bold THEN '**' || text || '**' WHEN italic THEN '*' || text || '*' ELSE text END, '' ORDER BY i) AS styled,
    string_agg(CASE WHEN italic THEN '<em>' ELSE '' END || CASE WHEN bold THEN '<strong>' ELSE '' END || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
      || CASE WHEN bold THEN '</strong>' ELSE '' END || CASE WHEN italic THEN '</em>' ELSE '' END, '' ORDER BY i) AS html FROM final_run GROUP BY doc_id, block_ordinal),
heads AS (SELECT doc_id, block_ordinal, arg_min(kind, {{k}}) AS type, arg_min(CASE WHEN type = 'heading' THEN 2 ELSE 1 END, {{k}}) AS level, arg_min(list_ordered, {{k}}) AS list_ordered,
          arg_min(CASE WHEN kind = 'footnote' THEN coalesce(nullif(regexp_extract(raw, '^([0-9]{{{{1,3}}}})[.)]?\\s+', 1), ''), '~') ELSE '~' END, {{k}}) AS marker, arg_min(indented, {{k}}) AS first_line_indent, min(page_index) AS source_page
          FROM numbered GROUP BY doc_id, block_ordinal),
blocks_ AS (SELECT h.doc_id, h.block_ordinal, h.type, j.text, j.styled, j.html, h.level, h.list_ordered, nullif(h.marker, '~') AS footnote_marker, h.first_line_indent, h.source_page FROM heads h JOIN joined_run j USING (doc_id, block_ordinal)),
islands AS (SELECT *, sum(CASE WHEN type = 'list_item' AND before = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_ordinal) AS island
            FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY block_ordinal) AS before FROM blocks_)),
listed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY block_ordinal) AS item, first_value(list_ordered) OVER (PARTITION BY doc_id, island ORDER BY block_ordinal) AS ordered,
           coalesce(lead(island) OVER (PARTITION BY doc_id ORDER BY block_ordinal) <> island, true) AS closes FROM islands)"""
_MERGED = _MERGED.replace("{k}", "page_index * 1000000000 + reading_order * 1000000 + para").replace("{{1,3}}", "{1,3}")

_ITEM = "CASE WHEN ordered THEN item || '. ' ELSE '- ' END"
_JOIN = "regexp_replace(string_agg(piece || CASE WHEN closes THEN chr(10) || chr(10) ELSE chr(10) END, '' ORDER BY block_ordinal), '^\\s+|\\s+$', '', 'g') || chr(10)"

ORACLES |= {
    "document_blocks": f"WITH {_MERGED} SELECT doc_id, block_ordinal, type, text, styled, level, list_ordered, footnote_marker, first_line_indent, source_page FROM blocks_",
    "render_text": f"""WITH {_MERGED}, p AS (SELECT *, CASE type WHEN 'title' THEN upper(replace(text, 'ß', 'SS')) || chr(10) || repeat('=', least(length(text), 60)) WHEN 'heading' THEN text || chr(10) || repeat('-', least(length(text), 60))
        WHEN 'quote' THEN '    ' || text WHEN 'footnote' THEN CASE WHEN footnote_marker IS NOT NULL THEN '[' || footnote_marker || '] ' ELSE '' END || text WHEN 'list_item' THEN {_ITEM} || text ELSE text END AS piece FROM listed)
        SELECT doc_id, {_JOIN} AS content FROM p GROUP BY doc_id""",
    "render_markdown": f"""WITH {_MERGED}, p AS (SELECT *, CASE type WHEN 'title' THEN '# ' || styled WHEN 'heading' THEN '## ' || styled WHEN 'quote' THEN '> ' || styled
        WHEN 'footnote' THEN '[^' || coalesce(footnote_marker, '*') || ']: ' || styled WHEN 'list_item' THEN {_ITEM} || styled ELSE styled END AS piece FROM listed)
        SELECT doc_id, {_JOIN} AS content FROM p GROUP BY doc_id""",
    "render_html": f"""WITH {_MERGED}, p AS (SELECT *, CASE type WHEN 'title' THEN '<h1>' || html || '</h1>' WHEN 'heading' THEN '<h2>' || html || '</h2>' WHEN 'quote' THEN '<blockquote><p>' || html || '</p></blockquote>'
        WHEN 'footnote' THEN '<p class="footnote">' || CASE WHEN footnote_marker IS NOT NULL THEN '<sup>' || footnote_marker || '</sup> ' ELSE '' END || html || '</p>'
        WHEN 'list_item' THEN CASE WHEN item = 1 THEN CASE WHEN ordered THEN '<ol>' ELSE '<ul>' END || chr(10) ELSE '' END || '<li>' || html || '</li>' || CASE WHEN closes THEN chr(10) || CASE WHEN ordered THEN '</ol>' ELSE '</ul>' END ELSE '' END
        ELSE CASE WHEN first_line_indent THEN '<p class="indent">' ELSE '<p>' END || html || '</p>' END AS piece FROM listed),
        body AS (SELECT doc_id, string_agg(piece, chr(10) ORDER BY block_ordinal) AS body, coalesce(nullif(arg_min(text, block_ordinal) FILTER (WHERE type = 'title'), ''), 'Documento') AS title FROM p GROUP BY doc_id)
        SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="' || lang || '">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>'
        || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</title>' || chr(10) || '<style></style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || body || chr(10) || '</body>' || chr(10) || '</html>' AS content
        FROM body JOIN documents USING (doc_id)""",
    "job_age_cutoff": "SELECT user_id AS job_id, event_id AS seq, ts, event_type AS status FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) - INTERVAL 5 DAY FROM events)",
}

_FORMS = """f AS (SELECT o_orderkey, o_orderkey % 23 = 0 AS bad, CASE WHEN o_orderkey % 11 = 3 THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'tesseract' WHEN o_orderkey % 3 = 1 THEN 'easyocr' ELSE 'paddleocr' END AS engine,
        o_orderkey % 7 = 0 AS no_language, o_orderkey % 13 = 0 AS odt, o_orderkey % 13 <> 0 AND o_orderkey % 17 = 0 AS no_format, o_orderkey % 19 AS psm, o_orderkey % 10 AS columns_ FROM orders)"""
_IN_FLOW = "type IN ('title', 'heading', 'body_text')"
_SHIFTED = "shifted AS (SELECT * REPLACE (CASE WHEN par_num % 3 = 1 AND block_num BETWEEN 100000 AND 599999 THEN l + 100 ELSE l END AS l) FROM words),\nlines AS ("

ORACLES |= {
    "column_assign": f"WITH {_ORDERED} SELECT doc_id, page_index, block_num, par_num, zone, l, r, column_index::BIGINT AS column_index FROM regions WHERE {_IN_FLOW}",
    "title_heading_classify": f"""WITH {_ORDERED} SELECT doc_id, page_index, block_num, par_num, zone, type, round(p.line_height, 6) AS line_height
        FROM typed JOIN parted p USING (doc_id, page_index, zone, block_num, par_num) WHERE {_IN_FLOW}""",
    "quote_detect": f"""WITH {_MERGED.replace("lines AS (", _SHIFTED, 1).replace("AS n_words FROM words", "AS n_words FROM shifted", 1)}
        SELECT doc_id, page_index, reading_order, para::BIGINT AS para, kind AS type FROM kind WHERE kind IN ('paragraph', 'quote', 'list_item')""",
    "export_names": """WITH p AS (SELECT DISTINCT source || '/' || (doc_id % 7) || CASE WHEN doc_id % 5 = 0 THEN '~2' ELSE '' END || '.png' AS doc_id FROM documents),
        r AS (SELECT doc_id, regexp_extract(doc_id, '([^/]+)\\.png$', 1) AS stem, row_number() OVER (PARTITION BY regexp_extract(doc_id, '([^/]+)\\.png$', 1) ORDER BY doc_id) AS n FROM p)
        SELECT doc_id, CASE WHEN n = 1 AND stem NOT LIKE '%~2' THEN stem ELSE stem || '~' || n END AS name FROM r""",
    "config_rules": f"""WITH {_FORMS}, v AS (SELECT o_orderkey, CASE WHEN bad THEN 0 WHEN no_language THEN 1 WHEN no_format THEN 2 WHEN engine = 'none' THEN 3 WHEN psm > 13 THEN 4 WHEN odt THEN 8 WHEN columns_ NOT BETWEEN 1 AND 8 THEN 9 END AS position FROM f)
        SELECT o_orderkey, coalesce(position, -1)::INTEGER AS position, CASE position WHEN 0 THEN 'no JSON object' WHEN 1 THEN 'ocr.languages: one at least' WHEN 2 THEN 'export.formats: one at least' WHEN 3 THEN 'ocr.engine: unknown'
          WHEN 4 THEN 'ocr.psm: 0 to 13' WHEN 8 THEN 'export.formats: unknown' WHEN 9 THEN 'layout.max_columns: 1 to 8' ELSE '' END AS message FROM v""",
    "runnable_forms": f"WITH {_FORMS} SELECT o_orderkey FROM f WHERE NOT bad AND engine IN ('tesseract', 'easyocr')",
    "job_compaction": f"WITH {_LATEST} SELECT * FROM latest WHERE status <> 'purchase'",
    "job_cleanup": f"""WITH {_LATEST}, newest AS (SELECT * FROM latest ORDER BY ts DESC, job_id DESC LIMIT 200)
        SELECT * FROM newest WHERE ts < (SELECT max(ts) - INTERVAL 6 HOUR FROM latest)""",
}
