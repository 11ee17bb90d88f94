"""Views that stand in for invoices, jobs and pages, derived from the driver's tables by arithmetic on keys.

Each is one SQL text for both engines; where their dialects part, the text is made for the one asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")


def _digits(n: str, wide: int) -> str:
    return f"lpad(cast({n} as string), {wide}, '0')"


def _grouped(w: str, mark: str) -> str:
    """A whole number in groups of three digits."""
    part = lambda low, high: f"cast(({w} % {high} - {w} % {low}) / {low} as bigint)"
    million = f"cast(({w} - {w} % 1000000) / 1000000 as bigint)"
    below = f"concat('{mark}', {_digits(f'({w} % 1000)', 3)})"
    return f"case when {w} >= 1000000 then concat(cast({million} as string), '{mark}', {_digits(part(1000, 1000000), 3)}, {below}) when {w} >= 1000 then concat(cast({part(1000, 1000000)} as string), {below}) else cast({w} as string) end"


def _money(cents: str, style: str) -> str:
    """A text for an amount in cents, in one of four printed styles by the number style, from 0 to 3."""
    whole, two = f"cast(({cents} - {cents} % 100) / 100 as bigint)", _digits(f"({cents} % 100)", 2)
    return (
        f"case {style} when 0 then concat({_grouped(whole, ',')}, '.', {two}) when 1 then concat({_grouped(whole, '.')}, ',', {two}) "
        f"when 2 then concat('$ ', {_grouped(whole, ' ')}, ',', {two}) else concat('each ', cast({whole} as string), ',', {two}) end"
    )


def _date(day: str, style: str) -> str:
    y, m, d = f"cast(year({day}) as string)", _digits(f"month({day})", 2), _digits(f"day({day})", 2)
    name = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast((month({day}) - 1) * 3 + 1 as int), 3)"
    return f"case {style} when 0 then concat({y}, '-', {m}, '-', {d}) when 1 then concat({d}, '/', {m}, '/', {y}) when 2 then concat({d}, '.', {m}, '.', substr({y}, 3, 2)) else concat({name}, ' ', cast(day({day}) as string), ', ', {y}) end"


def sql(name: str, duck: bool = False) -> str:
    """The view's SQL; tables stand in braces for Spark, bare for DuckDB."""
    t = {x: x if duck else "{" + x + "}" for x in TABLES}
    div = lambda a, b: f"({a} // {b})" if duck else f"({a} div {b})"
    later = lambda ts, s: f"({ts} + to_seconds({s}))" if duck else f"timestampadd(SECOND, {s}, {ts})"
    cents = "cast(round(o_totalprice * 100) as bigint)"
    if name == "invoices":
        body = f"""SELECT o_orderkey, c_name AS client, concat('INV-', {_digits('o_orderkey', 8)}) AS invoice_no, {_date('o_orderdate', 'o_orderkey % 4')} AS invoice_date,
          {_money(cents, 'o_orderkey % 4')} AS total_net_worth, o_orderdate, {cents} AS cents
          FROM {t['orders']} JOIN {t['customer']} ON o_custkey = c_custkey"""
        off = "o_orderkey % 7 = 0 AND o_orderkey % 3 ="
        truth = f"""SELECT *, concat(CASE WHEN {off} 0 THEN 'X' ELSE '' END, 'inv ', {_digits('o_orderkey', 8)}) AS gt_no,
          {_date('o_orderdate', '0')} AS gt_iso, concat(cast(year(o_orderdate) + CASE WHEN {off} 1 THEN 1 ELSE 0 END as string), '-', {_digits('month(o_orderdate)', 2)}, '-', {_digits('day(o_orderdate)', 2)}) AS gt_date,
          {_money('(cents + CASE WHEN ' + off + ' 2 THEN 100 ELSE o_orderkey % 5 END)', '0')} AS gt_total FROM ({body}) i"""
        head = "'\"header\": {\"invoice_no\": \"', gt_no, '\", \"invoice_date\": \"', gt_date, '\"}, '"
        inner = f"concat('{{', CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat({head}) END, '\"summary\": {{\"total_net_worth\": \"', gt_total, '\"}}}}')"
        if not duck:
            inner = inner.replace("{", "{{").replace("}", "}}")
        nested = f"SELECT *, {inner} AS inner_json FROM ({truth}) t"
        open_, close = ("{", "}") if duck else ("{{", "}}")
        return f"""SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '{open_}"json": "not json{open_}{open_}"{close}' WHEN o_orderkey % 2 = 0 THEN concat('{open_}"json": "', replace(inner_json, chr(34), concat(chr(92), chr(34))), '"{close}')
          ELSE concat('{open_}"json": ', inner_json, '{close}') END AS ground_truth FROM ({nested}) n"""
    if name == "jobs":
        status = "CASE o_orderkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'ocr_processing' WHEN 2 THEN 'ocr_done' WHEN 3 THEN 'extracting' WHEN 4 THEN 'extracted' WHEN 5 THEN 'validating' WHEN 6 THEN 'done' ELSE 'failed' END"
        return f"""SELECT concat('job-', {_digits('o_orderkey', 8)}) AS job_id, o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'other' ELSE 'default' END AS tenant_id, {status} AS status,
          concat('invoices/t', cast(o_custkey % 5 as string), '/job-', {_digits('o_orderkey', 8)}, '/input.', CASE o_orderkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' ELSE 'webp' END) AS input_file_path,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN cast(0 as double) ELSE cast(o_orderkey % 1000 as double) / cast(1000 as double) END AS confidence_score,
          CASE WHEN o_orderkey % 8 = 7 THEN concat('Failed: line ', cast(o_custkey as string), ' of the ', o_orderpriority, ' request could not be read, and this note is longer than the table shows') END AS error_message,
          cast(o_orderkey % 4 as int) AS retry_count, cast(o_orderdate as timestamp) AS created_at, {later('cast(o_orderdate as timestamp)', 'cast(o_orderkey % 1800 as int)')} AS updated_at FROM {t['orders']}"""
    if name == "job_events":
        status = "CASE event_id % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'ocr_processing' WHEN 2 THEN 'ocr_done' WHEN 3 THEN 'extracting' WHEN 4 THEN 'extracted' WHEN 5 THEN 'validating' WHEN 6 THEN 'done' ELSE 'failed' END"
        return f"SELECT concat('u', cast(user_id as string)) AS job_id, event_id AS seq, cast(ts as timestamp) AS stamp, {status} AS status, CASE WHEN event_id % 3 = 0 THEN value END AS confidence_score, cast(event_id % 5 as int) AS retry_count, CASE WHEN event_id % 4 = 0 THEN event_type END AS error_message FROM {t['events']}"
    if name == "amount_texts":
        key = "(l_orderkey * 7 + l_linenumber)"
        money = _money("cast(round(l_extendedprice * 100) as bigint)", f"{key} % 4")
        return f"""SELECT l_orderkey, l_linenumber, l_extendedprice, CASE {key} % 12 WHEN 0 THEN concat('-', cast(l_partkey as string), ',', '4') WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN concat('1.', cast(l_suppkey as string), '.567')
          WHEN 4 THEN concat(cast(l_partkey as string), ',45') WHEN 5 THEN concat('1,', cast(l_suppkey as string), ',56') ELSE {money} END AS raw FROM {t['lineitem']}"""
    if name == "noisy":
        plain = "concat('Netprice ', cast(l_partkey as string), ' x', cast(l_extendedprice as string), CASE WHEN l_linenumber % 2 = 0 THEN ' VAT ' ELSE ' at ' END, cast(l_suppkey as string), '0Z  Grossworth ', cast(l_orderkey as string), '   ', cast(l_quantity as string))"
        return f"SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_orderkey % 3 = 0 THEN replace({plain}, '0', 'O') WHEN l_orderkey % 3 = 1 THEN replace({plain}, '1', 'l') ELSE {plain} END AS raw FROM {t['lineitem']}"
    if name == "name_pairs":  # whole names of parts and clients, and what OCR might read
        names = f"SELECT concat('p', cast(p_partkey as string)) AS id, concat(p_name, ' ', p_type, ' on the wall ', p_brand) AS truth FROM {t['part']} UNION ALL SELECT concat('c', cast(c_custkey as string)), concat(c_name, ' all in the ', c_mktsegment, ' ', cast(c_nationkey as string)) FROM {t['customer']}"
        return f"SELECT id, truth, CASE WHEN length(id) % 3 = 0 THEN concat(substr(truth, 4), ' x') ELSE replace(replace(replace(replace(truth, 'the ', 'teh '), 'on', '0n'), 'll', 'l'), '0', 'O') END AS prediction FROM ({names}) n"
    if name == "line_items":
        return f"SELECT l_orderkey, l_linenumber, {_money('cast(round(l_extendedprice * 100) as bigint)', '(l_orderkey % 4)')} AS item_net_worth, l_extendedprice FROM {t['lineitem']}"
    if name == "pixels":  # 16 by 16 pictures, a background of one level and a darker pattern
        return f"""SELECT p_partkey, cast({div('k', 16)} as int) AS y, cast(k % 16 as int) AS x, cast(CASE WHEN (p_partkey + k) % 7 = 0 THEN (p_partkey * 31 + k * 17) % 256 ELSE 200 + p_partkey % 50 END as int) AS v
          FROM (SELECT p_partkey, {"unnest(range(256))" if duck else "explode(sequence(0, 255))"} AS k FROM {t['part']}) g"""
    if name == "image_features":
        f = lambda a, m, s: f"cast((p_partkey * {a}) % {m} as double) / cast({s} as double)"
        return f"SELECT p_partkey, {f(37, 700, 1)} AS sharpness, {f(53, 260, 1)} AS contrast, {f(29, 256, 1)} AS brightness, {f(41, 400, 10)} AS noise_snr, {f(61, 120, 1000)} AS edge_density, {f(43, 500, 20)} AS bg_std, {f(59, 256, 1)} AS bg_mean FROM {t['part']}"
    raise KeyError(name)


def spread(df: DataFrame, key: str, each: int = 16 << 20) -> DataFrame:
    """df over at least twice as many tasks as there are cores, for work that costs far more by byte than moving it: a table of few row groups, or some very
    long texts, would keep most cores idle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, min(100_000, -(-size // each)))
    return df.repartition(tasks, key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = sql(name)
    used = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in TABLES if "{" + x + "}" in text}
    return spark.sql(text, **used)
