"""DuckDB SQL for the catalogue's queries, over the same derived views."""

from __future__ import annotations

from inkspan.plans import pictures, services
from inkspan.plans.catalogue import NOW
from inkspan.plans.derived import sql


def _with(*views: str) -> str:
    return "WITH " + ", ".join(f"{v} AS ({sql(v, True)})" for v in views) + " "


def _amount(x: str) -> str:
    b = f"regexp_replace({x}, '[^0-9,.-]', '', 'g')"
    return (
        f"try_cast(CASE WHEN contains({b}, ',') AND contains({b}, '.') THEN CASE WHEN strpos({b}, ',') < strpos({b}, '.') THEN replace({b}, ',', '') ELSE replace(replace({b}, '.', ''), ',', '.') END "
        f"WHEN contains({b}, ',') THEN CASE WHEN regexp_matches({b}, ',[0-9]{{2}}$') THEN replace({b}, ',', '.') ELSE replace({b}, ',', '') END ELSE {b} END AS DOUBLE)"
    )


def _day(x: str) -> str:
    n = f"regexp_replace({x}, '[./]', '-', 'g')"
    numeric = [("%Y-%m-%d", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), ("%d-%m-%Y", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"), ("%m-%d-%Y", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"), ("%y-%m-%d", "[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}"), ("%d-%m-%y", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}"), ("%m-%d-%y", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}")]
    tries = [f"CASE WHEN regexp_full_match({n}, '{p}') THEN try_strptime({n}, '{f}') END" for f, p in numeric]
    return f"coalesce({', '.join(tries)}, try_strptime({x}, '%b %d, %Y'))::DATE"


def _bare(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^a-zA-Z0-9]', '', 'g'))"


def _same_no(a: str, b: str) -> str:
    x, y = _bare(a), _bare(b)
    return f"CASE WHEN {x} = '' OR {y} = '' THEN {x} = {y} ELSE contains({x}, {y}) OR contains({y}, {x}) END"


def _same_day(a: str, b: str) -> str:
    x, y = _day(a), _day(b)
    return f"(coalesce({x} = {y} OR (year({x}) = year({y}) AND day({x}) = month({y}) AND month({x}) = day({y})), false) OR lower(trim({a})) = lower(trim({b})))"


def _same_amount(a: str, b: str) -> str:
    x, y = _amount(a), _amount(b)
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN abs({x} - {y}) <= 0.05 ELSE lower(trim({a})) = lower(trim({b})) END"


#: Each invoice's verdict against its ground truth.
VERDICTS = f"""truths AS (SELECT o_orderkey, invoice_no, invoice_date, total_net_worth, ground_truth, json_type(ground_truth, '$.json') AS kind,
  CASE WHEN json_type(ground_truth, '$.json') = 'VARCHAR' THEN try_cast(ground_truth ->> '$.json' AS JSON) ELSE ground_truth -> '$.json' END AS j FROM invoices),
fields AS (SELECT *, (j -> '$.header') IS NOT NULL AND (j -> '$.summary') IS NOT NULL AS whole, j ->> '$.header.invoice_no' AS no, j ->> '$.header.invoice_date' AS day, j ->> '$.summary.total_net_worth' AS total FROM truths),
marks AS (SELECT *, CASE WHEN ground_truth IS NULL THEN true WHEN j IS NULL THEN false WHEN NOT whole THEN true ELSE {_same_no('invoice_no', 'no')} END AS m_no,
  CASE WHEN ground_truth IS NULL THEN true WHEN j IS NULL THEN false WHEN NOT whole THEN true ELSE {_same_day('invoice_date', 'day')} END AS m_day,
  CASE WHEN ground_truth IS NULL THEN true WHEN j IS NULL THEN false WHEN NOT whole THEN true ELSE {_same_amount('total_net_worth', 'total')} END AS m_total FROM fields),
verdicts AS (SELECT o_orderkey, ground_truth IS NOT NULL AS evaluated, m_no AND m_day AND m_total AS passed, m_no::INT::DOUBLE AS invoice_no, m_day::INT::DOUBLE AS invoice_date, m_total::INT::DOUBLE AS total_net_worth FROM marks)"""

_EVALUATED = _with("invoices", "jobs")[:-1] + f", {VERDICTS}, done AS (SELECT j.*, v.passed, v.invoice_no, v.invoice_date, v.total_net_worth FROM jobs j JOIN verdicts v USING (o_orderkey) WHERE status = 'done' AND o_orderkey % 7 <> 3) "
_SECONDS = "date_diff('microsecond', created_at, updated_at) / 1e6"
_FLIGHT = "status IN ('queued', 'ocr_processing', 'extracting', 'validating', 'ocr_done', 'extracted')"
_STUCK = _with("jobs")[:-1] + f", stuck AS (SELECT *, date_diff('microsecond', updated_at, TIMESTAMP '{NOW}') AS late FROM jobs WHERE {_FLIGHT} AND date_diff('microsecond', updated_at, TIMESTAMP '{NOW}') > 600000000) "
_ALLOWED = """CASE WHEN {a} IS NULL OR {a} = {b} THEN true WHEN {a} = 'queued' THEN {b} IN ('ocr_processing', 'failed') WHEN {a} = 'ocr_processing' THEN {b} IN ('ocr_done', 'queued', 'failed')
  WHEN {a} = 'ocr_done' THEN {b} IN ('extracting', 'ocr_processing', 'failed') WHEN {a} = 'extracting' THEN {b} IN ('extracted', 'queued', 'ocr_processing', 'failed')
  WHEN {a} = 'extracted' THEN {b} IN ('validating', 'done', 'ocr_processing', 'failed') WHEN {a} = 'validating' THEN {b} IN ('done', 'failed') ELSE false END"""
_PERSISTENT = "('persistent', 'value', 'key', 'type')"


def _histogram(source: str, value: str, bins: int) -> str:
    return f"""{source[:-1]}, v AS (SELECT {value} AS v FROM done WHERE {value} IS NOT NULL AND {value} >= 0), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    b AS (SELECT lo, hi, least({bins}, 1 + floor((v - lo) * {bins} / (hi - lo)))::INT AS bin FROM v, e)
    SELECT bin, round(lo + (hi - lo) / {bins} * (bin - 1), 6) AS low, round(lo + (hi - lo) / {bins} * bin, 6) AS high, count(*) AS cnt FROM b GROUP BY bin, lo, hi"""


_SCORES = """scores AS (SELECT *, least(sharpness / 500.0, 1.0)::DOUBLE AS sharpness_score, least(contrast / 200.0, 1.0)::DOUBLE AS contrast_score,
  CASE WHEN brightness BETWEEN 120 AND 220 THEN 1.0 ELSE greatest(0.0, 1 - least(abs(brightness - 120), abs(brightness - 220)) / 100.0) END::DOUBLE AS brightness_score,
  least(noise_snr / 25.0, 1.0)::DOUBLE AS noise_score, greatest(0.0, 1 - bg_std / 50.0)::DOUBLE AS bg_uniformity FROM image_features)"""
_SOURCE = """points AS (SELECT *,
  (CASE WHEN edge_density > 0.08 THEN 2.0 WHEN edge_density > 0.05 THEN 1.0 ELSE 0 END) + (CASE WHEN bg_std < 5 AND bg_mean > 230 THEN 2.0 WHEN bg_std < 10 AND bg_mean > 200 THEN 1.0 ELSE 0 END)
    + (CASE WHEN sharpness > 500 THEN 1.0 ELSE 0 END) + (CASE WHEN noise_snr > 30 THEN 0.5 ELSE 0 END) AS sw,
  (CASE WHEN edge_density > 0.08 THEN 0 WHEN edge_density > 0.05 THEN 0.5 ELSE 0 END) + (CASE WHEN bg_std < 5 AND bg_mean > 230 THEN 0 WHEN bg_std < 10 AND bg_mean > 200 THEN 1.5 WHEN bg_std < 15 THEN 0.5 ELSE 0 END)
    + (CASE WHEN sharpness > 500 THEN 0.5 WHEN sharpness > 200 THEN 1.0 ELSE 0 END) + (CASE WHEN noise_snr > 30 THEN 0.5 ELSE 0 END) AS sc,
  (CASE WHEN edge_density > 0.05 THEN 0 ELSE 0.5 END) + (CASE WHEN bg_std < 5 AND bg_mean > 230 THEN 0 WHEN bg_std < 10 AND bg_mean > 200 THEN 0 WHEN bg_std < 15 THEN 1.0 ELSE 0 END)
    + (CASE WHEN sharpness > 500 THEN 0 WHEN sharpness > 200 THEN 0.5 ELSE 0 END) AS cc,
  (CASE WHEN edge_density > 0.05 THEN 0 ELSE 0.5 END) + (CASE WHEN bg_std < 15 THEN 0 ELSE 1.5 END) + (CASE WHEN sharpness < 100 THEN 2.0 ELSE 0 END) + (CASE WHEN noise_snr > 30 THEN 0 WHEN noise_snr < 15 THEN 1.5 ELSE 0 END)
    + (CASE WHEN contrast < 100 THEN 1.0 ELSE 0 END) AS cd FROM scores),
named AS (SELECT *, CASE WHEN sw >= greatest(sc, cc, cd) THEN 'software_pdf' WHEN sc >= greatest(cc, cd) THEN 'scanner' WHEN cc >= cd THEN 'camera_clean' ELSE 'camera_degraded' END AS source FROM points)"""


def _fix(x: str) -> str:
    """RE2 has no look-around: a digit pair is replaced twice, since pairs overlap."""
    text = f"replace(replace({x}, 'Grossworth', 'Gross worth'), 'Netprice', 'Net price')"
    for pattern, put in ((r"(\d)[Oo](\d)", r"\10\2"), (r"(\d)[Oo](\d)", r"\10\2"), (r"\b[Oo](\d+[,.]\d+)\b", r"0\1"), (r"(\d)l(\d)", r"\11\2"), (r"(\d)l(\d)", r"\11\2")):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


def _mended(x: str) -> str:
    """The whole repair of one text."""
    f = _fix(f"replace(replace(replace(replace(replace({x}, '\ufffd', ''), 'grossworth', 'gross worth'), 'Networth', 'Net worth'), 'networth', 'net worth'), 'netprice', 'net price')")
    percent = f"CASE WHEN regexp_matches(upper({f}), 'VAT|TAX|IVA|%') THEN regexp_replace({f}, '\\b(\\d+)0Z\\b', '\\1%', 'g') ELSE regexp_replace({f}, '\\b(\\d{{1,2}})0Z\\b', '\\1%', 'g') END"
    return f"CASE WHEN regexp_matches({x}, '[0-9\ufffd]|worth|etprice') THEN regexp_replace({percent}, '(\\d)\\s{{2,}}(\\d)', '\\1 \\2', 'g') ELSE {x} END"


def _word_rate(prediction: str, truth: str) -> str:
    """DuckDB's levenshtein counts bytes: words are written as one ASCII character each, of which these names need under 94."""
    ws = lambda x: f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
    every = f"list_distinct(list_concat({ws(truth)}, {ws(prediction)}))"
    coded = lambda x: f"array_to_string(list_transform({ws(x)}, lambda w: chr((32 + list_position({every}, w))::INT)), '')"
    return f"levenshtein({coded(prediction)}, {coded(truth)}) / len({ws(truth)})"


def oracle_sql() -> dict[str, str]:
    inv, job = _with("invoices"), _with("jobs")
    digits = r"\b(\d{1,2})0Z\b"
    fixed = f"""{_with('noisy')[:-1]}, f AS (SELECT *, {_fix('raw')} AS f FROM noisy),
      p AS (SELECT *, CASE WHEN regexp_matches(upper(f), 'VAT|TAX|IVA|%') THEN regexp_replace(f, '\\b(\\d+)0Z\\b', '\\1%', 'g') ELSE regexp_replace(f, '{digits}', '\\1%', 'g') END AS p FROM f)
      SELECT l_orderkey, l_linenumber, l_extendedprice, regexp_replace(p, '(\\d)\\s{{2,}}(\\d)', '\\1 \\2', 'g') AS fixed FROM p"""
    sums = f"""{_with('invoices', 'line_items')[:-1]}, s AS (SELECT l_orderkey, count(*) AS n, sum({_amount('item_net_worth')}) AS total FROM line_items GROUP BY l_orderkey)
      SELECT o_orderkey, coalesce(n, 0)::INT AS n_items, coalesce(abs(total - {_amount('total_net_worth')}) > 0.05, false) AS differs FROM invoices LEFT JOIN s ON l_orderkey = o_orderkey"""
    part_row = "(50 + p_partkey % 40 - 50)::DOUBLE / (150 + p_partkey % 40)"
    return pictures.oracle_sql(_SCORES, _SOURCE) | services.oracle_sql() | {
        "amount_parse": f"{_with('amount_texts')} SELECT l_orderkey, l_linenumber, raw, {_amount('raw')} AS amount FROM amount_texts",
        "amount_match": f"{inv} SELECT o_orderkey, {_same_amount('total_net_worth', 'gt_total')} AS same FROM invoices",
        "date_parse": f"{inv} SELECT o_orderkey, invoice_date, strftime({_day('invoice_date')}, '%Y-%m-%d') AS day FROM invoices",
        "date_match": f"{inv} SELECT o_orderkey, {_same_day('invoice_date', 'gt_date')} AS same FROM invoices",
        "invoice_no_normalise": f"{inv} SELECT o_orderkey, {_bare('gt_no')} AS bare FROM invoices",
        "invoice_no_match": f"{inv} SELECT o_orderkey, {_same_no('invoice_no', 'gt_no')} AS same FROM invoices",
        "ocr_fix": fixed,
        "validate_extraction": f"{inv} SELECT o_orderkey, o_orderkey % 23 <> 0 AS valid FROM invoices",
        "items_sum_check": sums,
        "extraction_parse": f"{inv} SELECT o_orderkey, o_orderkey % 5 > 1 AS valid, CASE WHEN o_orderkey % 5 > 1 THEN CASE WHEN o_orderkey % 23 = 0 THEN '  ' ELSE invoice_no END END AS invoice_no FROM invoices",
        "evaluate": f"{inv[:-1]}, {VERDICTS} SELECT * FROM verdicts",
        "evaluate_pyliteral": f"{inv[:-1]}, literal AS (SELECT * REPLACE ('{{\"json\": ' || inner_json || '}}' AS ground_truth) FROM invoices), {VERDICTS.replace('FROM invoices', 'FROM literal')} SELECT * FROM verdicts",
        "final_output_json": f"""{_with('invoices', 'line_items')[:-1]}, blanked AS (SELECT * REPLACE (CASE WHEN o_orderkey % 23 = 0 THEN '  ' ELSE invoice_no END AS invoice_no) FROM invoices), {VERDICTS.replace('FROM invoices', 'FROM blanked')},
          n AS (SELECT l_orderkey, count(*)::INT AS n_items FROM line_items GROUP BY l_orderkey)
          SELECT 'job-' || o_orderkey AS job_id, 'job_id,ocr_confidence,extraction,evaluation' AS keys, 0.5::DOUBLE AS confidence, b.invoice_no, coalesce(n_items, 0) AS n_items, b.total_net_worth AS total, evaluated, passed, true AS nulls_written
          FROM blanked b JOIN verdicts USING (o_orderkey) LEFT JOIN n ON l_orderkey = o_orderkey""",
        "layout_text": _LAYOUT,
        "kpi_summary": f"""{_EVALUATED[:-1]}, k AS (SELECT count(*) AS total, coalesce(sum(passed::INT), 0)::BIGINT AS passed_count, count(confidence_score) AS n_confidence, coalesce(avg(invoice_no), 0) AS a, coalesce(avg(invoice_date), 0) AS b,
          coalesce(avg(total_net_worth), 0) AS c, coalesce(avg(confidence_score), 0) AS d FROM done), r AS (SELECT *, CASE WHEN total > 0 THEN passed_count / total ELSE 0 END AS rate, (a + b + c) / 3 AS o FROM k)
          SELECT total, passed_count, CASE WHEN rate >= 0.7 THEN 'teal' WHEN rate >= 0.4 THEN 'amber' ELSE 'rose' END AS rating, CASE WHEN o >= 0.7 THEN 'teal' ELSE 'amber' END AS accuracy_rating, n_confidence,
          round(a, 6) AS avg_invoice_no, round(b, 6) AS avg_invoice_date, round(c, 6) AS avg_total_net_worth, round(o, 6) AS avg_overall, round(d, 6) AS avg_confidence, round(rate, 6) AS pass_rate FROM r""",
        "field_accuracy": f"""{_EVALUATED} SELECT 'invoice_no' AS field, count_if(invoice_no = 1)::BIGINT AS correct, count(*) AS total FROM done UNION ALL SELECT 'invoice_date', count_if(invoice_date = 1)::BIGINT, count(*) FROM done
          UNION ALL SELECT 'total_net_worth', count_if(total_net_worth = 1)::BIGINT, count(*) FROM done""",
        "status_counts": f"{job} SELECT status, count(*) AS cnt FROM jobs GROUP BY status",
        "latency_hist": _histogram(_EVALUATED, f"({_SECONDS})", 20),
        "confidence_hist": _histogram(_EVALUATED, "confidence_score", 25),
        "stuck_jobs": f"{_STUCK} SELECT job_id, status, round(late / 60e6, 3) AS minutes FROM stuck",
        "stuck_page": f"{_STUCK} SELECT job_id, status, 3 AS page, ((SELECT count(*) FROM stuck) + 4)::BIGINT // 5 AS pages FROM stuck ORDER BY created_at DESC, job_id LIMIT 5 OFFSET 10",
        "job_history": f"""{job} SELECT job_id, status, left(input_file_path, 40) AS file, CASE WHEN confidence_score <> 0 THEN printf('%.2f', confidence_score * 100) || '%' ELSE '-' END AS confidence,
          CASE WHEN {_SECONDS} >= 0 THEN printf('%.1f', {_SECONDS}) || 's' ELSE '' END AS duration, left(coalesce(nullif(error_message, ''), '-'), 60) AS error, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM jobs""",
        "all_jobs": f"{job} SELECT job_id, tenant_id, status, input_file_path, confidence_score, retry_count, error_message FROM jobs",
        "detail_table": f"""{_EVALUATED} SELECT job_id, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS passed, CASE WHEN invoice_no = 1 THEN 'correct' ELSE 'wrong' END AS invoice_no, CASE WHEN invoice_date = 1 THEN 'correct' ELSE 'wrong' END AS invoice_date,
          CASE WHEN total_net_worth = 1 THEN 'correct' ELSE 'wrong' END AS total_net_worth, printf('%.2f', coalesce(confidence_score, 0) * 100) || '%' AS confidence, strftime(created_at, '%Y-%m-%d %H:%M') AS created FROM done""",
        "done_jobs": f"{_EVALUATED} SELECT job_id, confidence_score, passed FROM done",
        "job_records": f"""{_with('invoices', 'jobs')[:-1]}, {VERDICTS} SELECT j.job_id AS id, tenant_id, status, input_file_path, confidence_score, NULL::VARCHAR AS ocr_data, NULL::VARCHAR AS extraction_data, CASE WHEN o_orderkey % 7 <> 3 THEN v.passed::VARCHAR END AS evaluation_data,
          '{{"n": ' || retry_count || '}}' AS ground_truth, error_message, retry_count, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM jobs j JOIN verdicts v USING (o_orderkey)""",
        "job_lookup": f"{job} SELECT job_id, status, input_file_path, retry_count FROM jobs WHERE job_id = 'job-00000007'",
        "tenant_lookup": f"{job} SELECT 'default' AS name, 100 AS rate_limit, count(*) AS n_jobs FROM jobs WHERE tenant_id = 'default'",
        "transition_violations": f"{_with('job_events')[:-1]}, l AS (SELECT job_id, seq, lag(status) OVER (PARTITION BY job_id ORDER BY stamp, seq) AS previous_status, status FROM job_events) SELECT * FROM l WHERE NOT ({_ALLOWED.format(a='previous_status', b='status')})",
        "job_snapshot": f"""{_with('job_events')} SELECT job_id, arg_max(status, seq) AS status, arg_max(confidence_score, seq) FILTER (confidence_score IS NOT NULL) AS confidence_score, arg_max(retry_count, seq) AS retry_count,
          arg_max(error_message, seq) FILTER (error_message IS NOT NULL) AS error_message, strftime(min(stamp), '%Y-%m-%d %H:%M:%S') AS created, strftime(max(stamp), '%Y-%m-%d %H:%M:%S') AS updated FROM job_events GROUP BY job_id""",
        "retry_decision": f"""{job[:-1]}, k AS (SELECT *, ['transient', 'value', 'not_found', 'persistent', 'network', 'key', 'type'][(o_orderkey % 7 + 1)::INT] AS error_kind, CASE WHEN status = 'extracted' THEN 'extracted' ELSE 'queued' END AS back FROM jobs),
          d AS (SELECT *, error_kind NOT IN {_PERSISTENT} AND retry_count < 3 AS again, {_ALLOWED.format(a='status', b='back')} AS may FROM k)
          SELECT job_id, error_kind, again, CASE WHEN again THEN CASE WHEN may THEN back ELSE status END WHEN status IN ('done', 'failed') THEN status ELSE 'failed' END AS next_status, (CASE WHEN again AND may THEN retry_count + 1 ELSE retry_count END)::INT AS next_retry,
          CASE WHEN again THEN CASE WHEN may THEN 'Transient failure (Retry #' || (retry_count + 1) || '): ' || tenant_id END WHEN status NOT IN ('done', 'failed') THEN 'Failed: ' || tenant_id END AS error_message FROM d""",
        "requeue_scan": f"{job} SELECT job_id, tenant_id, input_file_path, 0 AS retry_count FROM jobs WHERE status = 'queued'",
        "message_join": f"{job[:-1]}, m AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'lost-' || job_id ELSE job_id END AS job_id FROM jobs) SELECT m.job_id, j.status, CASE WHEN j.job_id IS NULL THEN 'value' END AS error_kind FROM m LEFT JOIN jobs j ON m.job_id = j.job_id WHERE j.status IS NULL OR j.status NOT IN ('done', 'failed')",
        "message_dedupe": f"{_with('job_events')} SELECT DISTINCT job_id || '/' || status AS message_id FROM job_events",
        "path_split": f"{job} SELECT job_id, split_part(input_file_path, '/', 1) AS bucket, substr(input_file_path, strpos(input_file_path, '/') + 1) AS key, split_part(input_file_path, '/', -1) AS filename FROM jobs",
        "path_build": f"{job} SELECT job_id, 'invoices/' || tenant_id || '/' || job_id || '/input.' || split_part(input_file_path, '.', -1) AS path, tenant_id || '/' || job_id || '/final_output.json' AS final_path FROM jobs",
        "ext_filter": f"""{job[:-1]}, f AS (SELECT job_id, job_id || CASE o_orderkey % 4 WHEN 0 THEN '.TIFF' WHEN 1 THEN '.v2.PNG' WHEN 2 THEN '' ELSE '.jpeg' END AS filename, CASE o_orderkey % 4 WHEN 0 THEN 'tiff' WHEN 1 THEN 'png' WHEN 2 THEN '' ELSE 'jpeg' END AS ext FROM jobs)
          SELECT *, ext IN ('pdf', 'png', 'jpg', 'jpeg', 'webp') AS allowed FROM f""",
        "prompt_build": "SELECT doc_id, md5('Read this invoice.' || chr(10) || 'File: doc' || doc_id || chr(10) || 'Read by: grid' || chr(10) || 'Text of the invoice:' || chr(10) || text) AS digest FROM documents",
        "cer_names": f"{_with('name_pairs')} SELECT id, round(levenshtein(prediction, truth) / length(truth), 9) AS cer FROM name_pairs",
        "wer_names": f"{_with('name_pairs')} SELECT id, round({_word_rate('prediction', 'truth')}, 9) AS wer FROM name_pairs",
        "field_exact_match": f"""{inv} SELECT o_orderkey, true AS no, invoice_date = gt_date OR lower(invoice_date) = lower(gt_date) AS date, true AS client, invoice_no = lower(invoice_no) AS raw_no, invoice_date = gt_date AS raw_date, false AS raw_client FROM invoices""",
        "row_cluster": _ROWS,
        "flat_text": f"SELECT doc_id, md5(array_to_string(list_transform({_WORDS}, lambda w: {_mended('w')}), chr(10))) AS digest FROM documents",
        "tabular_row": f"SELECT p_partkey, {part_row} > 0.15 AS tabular FROM part",
        "region_semi_join": "SELECT p_partkey FROM part WHERE p_partkey % 300 + 13 BETWEEN 95 AND 205",
        "region_join": "SELECT p_partkey FROM part WHERE p_partkey % 300 + 13 BETWEEN 95 AND 205",
        "quad_to_box": "SELECT p_partkey, trunc(least(p_size + 0.7, p_partkey, 7.9, 1.1))::INT AS x_min, trunc(least(3.2, 4, p_size, -2.5))::INT AS y_min, trunc(greatest(p_size + 0.7, p_partkey, 7.9, 1.1))::INT AS x_max, trunc(greatest(3.2, 4, p_size, -2.5))::INT AS y_max FROM part",
        "result_parse": "SELECT p_partkey, least(2, len(string_split(p_name, ' ')))::INT AS n, string_split(p_name, ' ')[1] AS first, round(CASE WHEN len(string_split(p_name, ' ')) >= 2 THEN (p_size / 100 + p_size / 200) / 2 ELSE p_size / 100 END, 6) AS confidence FROM part",
        "quality_scores": f"{_with('image_features')[:-1]}, {_SCORES} SELECT p_partkey, round(sharpness_score, 6) AS sharpness_score, round(contrast_score, 6) AS contrast_score, round(brightness_score, 6) AS brightness_score, round(noise_score, 6) AS noise_score, round(bg_uniformity, 6) AS bg_uniformity, round(0.3::DOUBLE * sharpness_score + 0.2::DOUBLE * contrast_score + 0.15::DOUBLE * brightness_score + 0.2::DOUBLE * noise_score + 0.15::DOUBLE * bg_uniformity, 6) AS overall_score FROM scores",
        "source_classify": f"{_with('image_features')[:-1]}, {_SCORES}, {_SOURCE} SELECT p_partkey, source FROM named",
        "strategy_select": f"""{_with('image_features')[:-1]}, {_SCORES}, {_SOURCE} SELECT p_partkey, source, CASE source WHEN 'software_pdf' THEN CASE WHEN sharpness_score > 0.8 AND noise_score > 0.8 THEN 'none' ELSE 'minimal' END
          WHEN 'scanner' THEN CASE WHEN sharpness_score > 0.7 AND noise_score > 0.7 THEN 'minimal' ELSE 'moderate' END WHEN 'camera_clean' THEN 'moderate' ELSE 'aggressive' END AS strategy FROM named""",
        "image_sharpness": f"""{_with('pixels')[:-1]}, a AS (SELECT p_partkey, list(v ORDER BY y, x) AS p FROM pixels GROUP BY p_partkey), c AS (SELECT p_partkey, p, unnest(range(256)) AS k FROM a),
          n AS (SELECT p_partkey, p, k, CASE WHEN k < 16 THEN k + 16 ELSE k - 16 END AS u, CASE WHEN k >= 240 THEN k - 16 ELSE k + 16 END AS d, CASE WHEN k % 16 = 0 THEN k + 1 ELSE k - 1 END AS l, CASE WHEN k % 16 = 15 THEN k - 1 ELSE k + 1 END AS r FROM c)
          SELECT p_partkey, round(var_pop(p[u + 1] + p[d + 1] + p[l + 1] + p[r + 1] - 4 * p[k + 1]), 4) AS sharpness FROM n GROUP BY p_partkey""",
        "image_contrast": f"{_with('pixels')} SELECT p_partkey, round(quantile_cont(v, 0.95) - quantile_cont(v, 0.05), 6) AS contrast, round(avg(v), 6) AS brightness FROM pixels GROUP BY p_partkey",
        "bg_uniformity": f"""{_with('pixels')[:-1]}, c AS (SELECT p_partkey, CASE WHEN y < 5 AND x < 5 THEN 1 WHEN y < 5 AND x >= 11 THEN 2 WHEN y >= 11 AND x < 5 THEN 3 WHEN y >= 11 AND x >= 11 THEN 4 END AS c, v FROM pixels),
          s AS (SELECT p_partkey, c, stddev_pop(v) AS s, avg(v) AS m FROM c WHERE c IS NOT NULL GROUP BY p_partkey, c) SELECT p_partkey, round(avg(s), 4) AS bg_std, round(avg(m), 6) AS bg_mean FROM s GROUP BY p_partkey""",
        "perspective_dims": """WITH p AS (SELECT p_partkey, (100 + p_size)::DOUBLE AS tx, 150::DOUBLE AS ty, 480::DOUBLE AS rx, (100 + p_partkey % 13)::DOUBLE AS ry, 520::DOUBLE AS bx, (500 + p_size)::DOUBLE AS bo, 80::DOUBLE AS lx, 450::DOUBLE AS ly FROM part)
          SELECT p_partkey, tx AS tl_x, bo AS br_y, trunc(greatest(sqrt((rx - tx) ** 2 + (ry - ty) ** 2), sqrt((bx - lx) ** 2 + (bo - ly) ** 2)))::INT AS width, trunc(greatest(sqrt((lx - tx) ** 2 + (ly - ty) ** 2), sqrt((bx - rx) ** 2 + (bo - ry) ** 2)))::INT AS height FROM p""",
        "resolution_target": """WITH s AS (SELECT p_partkey, (p_partkey * 13 % 6000 + 100)::INT AS h, (p_size * 90 + 10)::INT AS w FROM part), z AS (SELECT *, CASE WHEN greatest(h, w) < 2000 THEN 2000::DOUBLE / greatest(h, w) WHEN greatest(h, w) > 4000 THEN 4000::DOUBLE / greatest(h, w) ELSE 1 END AS f FROM s)
          SELECT p_partkey, trunc(h * f)::INT AS height, trunc(w * f)::INT AS width FROM z""",
        "in_flight_union": f"{job} SELECT job_id, status FROM jobs WHERE status IN ('queued', 'ocr_processing', 'extracting')",
    }


_WORDS = "regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')"
#: Every group of eight blocks shares a row: their baselines wave by 6 pixels at most, under half the height.
_ROWS = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w), k AS (SELECT doc_id, i // 8 AS r, count(*) AS n FROM b WHERE trim(word) <> '' GROUP BY ALL)
SELECT doc_id, count(*)::INT AS n_rows, string_agg(n::VARCHAR, ',' ORDER BY r) AS sizes FROM k GROUP BY doc_id"""

#: Eight words a row, all rows but perhaps the last in columns: the first row as text, then all of them as a table, then a last row that is none.
_LAYOUT = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
k AS (SELECT doc_id, i // 8 AS r, i, (i % 8) * 120 AS x, 8 * length(word) AS wide, {_mended('word')} AS word FROM b WHERE trim(word) <> ''),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, r ORDER BY i) AS c FROM k),
r AS (SELECT doc_id, r, count(*) AS n, string_agg(word, '    ' ORDER BY c) AS line, min(x) AS x0, arg_min(wide, c) AS w0, max(x) AS x1, arg_max(wide, c) AS w1 FROM c GROUP BY doc_id, r),
f AS (SELECT *, n >= 3 OR (n = 2 AND x1 + w1 - x0 > 0 AND (x1 - x0 - w0)::DOUBLE / (x1 + w1 - x0) > 0.15) AS tabular, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS k FROM r),
p AS (SELECT doc_id, count_if(tabular) AS p, max(CASE WHEN tabular THEN n END) AS wide FROM f GROUP BY doc_id),
cells AS (SELECT c.doc_id, f.k, c.c, c.word FROM c JOIN f ON c.doc_id = f.doc_id AND c.r = f.r WHERE f.tabular),
widths AS (SELECT doc_id, c, max(length(word)) AS width FROM cells GROUP BY doc_id, c),
lines AS (SELECT f.doc_id, f.k, '| ' || string_agg(rpad(coalesce(cells.word, ''), widths.width::INT, ' '), ' | ' ORDER BY widths.c) || ' |' AS line
  FROM f JOIN widths ON f.doc_id = widths.doc_id LEFT JOIN cells ON cells.doc_id = f.doc_id AND cells.k = f.k AND cells.c = widths.c WHERE f.tabular GROUP BY f.doc_id, f.k),
rules AS (SELECT doc_id, '|' || string_agg(repeat('-', (width + 2)::INT), '|' ORDER BY c) || '|' AS line FROM widths GROUP BY doc_id),
every AS (SELECT f.doc_id, 0 AS part, 0 AS k, line FROM f WHERE k = 1
  UNION ALL SELECT lines.doc_id, 1, 2 * k, line FROM lines JOIN p USING (doc_id) WHERE p >= 2
  UNION ALL SELECT rules.doc_id, 1, 3, line FROM rules JOIN p USING (doc_id) WHERE p >= 2
  UNION ALL SELECT f.doc_id, 2, k, line FROM f JOIN p USING (doc_id) WHERE k > 1 AND (NOT tabular OR p < 2)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY part, k) AS t FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(length(t), 0)::INT AS n_chars, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN t USING (doc_id)"""
