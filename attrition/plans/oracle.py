"""SQL (DuckDB dialect) for every oracle-checked operator.

Each statement is written from the definitions of the analysis: the transactions view and its cleaning are spelled out once in
``TX_CTES`` and prefixed to every statement.  Conventions shared with the
Spark side so that values hash identically: counts as BIGINT, money summed
as DECIMAL(18,2) then DOUBLE, averages as sum/count, and presentation
rounding half-up on the decimal value (``R2``).
"""

from __future__ import annotations

import datetime as dt

from attrition.calendar import TESTDATA_CALENDAR as CAL

D = lambda d: f"TIMESTAMP '{d.isoformat()} 00:00:00'"

OBS = D(CAL.observation)
PRED_END = D(CAL.prediction_end)
ELIG = D(CAL.eligibility_cutoff)
DORMANT = D(CAL.dormant_cutoff)
ACQ = D(CAL.acquisition_cutoff)
RECENT = D(CAL.recent_cutoff)


def R2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,6)), 2) AS DOUBLE)"


def R6(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 6) AS DOUBLE)"


def PCT(num: str, den: str) -> str:
    return R2(f"(100.0::DOUBLE * CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))")


def FRAC(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 86400000000.0::DOUBLE)"


def WHOLE(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0::DOUBLE) AS BIGINT)"


LV = "CAST(CAST(quantity AS DECIMAL(18,2)) * CAST(price AS DECIMAL(18,2)) AS DECIMAL(18,2))"

RAW_SQL = """
SELECT CASE WHEN l_returnflag='R' AND o_orderkey % 5 = 0 THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS invoice,
       CASE l_partkey % 200 WHEN 0 THEN 'POST' WHEN 1 THEN 'M' WHEN 2 THEN 'BANK CHARGES' WHEN 3 THEN 'gift_0001'
            ELSE CAST(l_partkey AS VARCHAR) || CASE WHEN l_partkey % 2 = 1 THEN 'A' ELSE '' END END AS stock_code,
       p_name AS description,
       CAST(CASE WHEN l_returnflag='R' AND o_orderkey % 5 IN (0,1) AND l_linenumber <> 7 THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS quantity,
       CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST((o_orderkey * 7919) % 86400 AS BIGINT)) AS invoice_ts,
       CAST(CASE WHEN l_partkey % 50 = 7 THEN 0.0 ELSE p_retailprice END AS DOUBLE) AS price,
       CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_custkey END AS customer_id,
       n_name AS country
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey
     JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
"""

TX_CTES = f"""
retail_raw AS ({RAW_SQL}),
tx AS (
  SELECT * FROM retail_raw
  WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C') AND quantity > 0 AND price > 0
    AND stock_code NOT IN ('POST','D','M','BANK CHARGES','PADS','DOT','CRUK','C2','AMAZONFEE')
)"""


def with_tx(body: str) -> str:
    """Prefix the transactions CTEs; ``body`` is 'name AS (...), ... SELECT ...'
    or a bare SELECT."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"WITH {TX_CTES}\n{body}"
    return f"WITH {TX_CTES},\n{body}"


SQL: dict[str, str] = {}


def register(key: str, body: str) -> None:
    SQL[key] = with_tx(body)


# Shapes that the statements below share.  Bucket borders are tables of (label, above, up_to) that ages are matched to.
PEOPLE = """people AS (
  SELECT customer_id, MIN(invoice_ts) AS born, MAX(invoice_ts) AS seen, COUNT(DISTINCT invoice) AS orders, COUNT(*) AS lines,
         SUM({lv}) AS spent
  FROM tx GROUP BY customer_id)""".format(lv=LV)


def ranges(name: str, rows: list[tuple[str, float | None]], start: float = -1e18) -> str:
    """A CTE of half-open intervals ``above < x <= up_to``; the last has no upper end."""
    low, out = start, []
    for label, high in rows:
        out.append(f"('{label}', {low}::DOUBLE, {'1e18' if high is None else high}::DOUBLE)")
        low = high
    return f"{name}(label, above, up_to) AS (VALUES {', '.join(out)})"


def status(column: str, cutoff: str) -> str:
    return f"IF({column} <= {cutoff}, 'Churned', 'Active')"


def within(x: str) -> str:
    return f"{x} > above AND {x} <= up_to"


# ---------------------------------------------------------------- churn rates (fixed values: bucket labels and borders)
register("churn_rate_overall", f"""
{PEOPLE}
SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (seen <= {OBS}) AS churned_customers,
       {PCT(f'COUNT(*) FILTER (seen <= {OBS})', 'COUNT(*)')} AS churn_rate_pct,
       CAST(SUM(orders) AS DOUBLE) / COUNT(*) AS avg_orders_per_customer
FROM people WHERE born <= {OBS}""")

register("churn_by_tenure", f"""
{PEOPLE},
{ranges('tenure', [('0-30 days', 30), ('31-90 days', 90), ('91-180 days', 180), ('181-365 days', 365), ('365+ days', None)])}
SELECT label AS tenure_bucket, COUNT(*) AS customers, COUNT(*) FILTER (seen <= {OBS}) AS churned,
       {PCT(f'COUNT(*) FILTER (seen <= {OBS})', 'COUNT(*)')} AS churn_rate_pct
FROM people JOIN tenure ON {within(FRAC('seen', 'born'))} WHERE born <= {OBS} GROUP BY label""")

register("churn_by_frequency", f"""
{PEOPLE},
{ranges('often', [('1 order', 1), ('2-3 orders', 3), ('4-5 orders', 5), ('6-10 orders', 10), ('10+ orders', None)])}
SELECT label AS frequency_bucket, COUNT(*) AS customers, COUNT(*) FILTER (seen <= {OBS}) AS churned,
       {PCT(f'COUNT(*) FILTER (seen <= {OBS})', 'COUNT(*)')} AS churn_rate_pct,
       {R2('CAST(SUM(orders) AS DOUBLE) / COUNT(*)')} AS avg_orders
FROM people JOIN often ON {within('orders')} WHERE born <= {OBS} GROUP BY label""")


def tile(n: int, order: str) -> str:
    """Number 1..n of a row's equal share of all rows in this order: the first (rows mod n) shares have one more."""
    p, size, extra = f"(ROW_NUMBER() OVER (ORDER BY {order}) - 1)", f"(COUNT(*) OVER () // {n})", f"(COUNT(*) OVER () % {n})"
    return (f"IF({p} < {extra} * ({size} + 1), {p} // ({size} + 1), {extra} + ({p} - {extra} * ({size} + 1)) // GREATEST({size}, 1)) + 1")


register("churn_by_monetary_quintile", f"""
{PEOPLE},
shares AS (SELECT spent, seen, {tile(5, 'spent, customer_id')} AS share FROM people WHERE born <= {OBS})
SELECT concat('Q', share) AS monetary_segment, COUNT(*) AS customers, COUNT(*) FILTER (seen <= {OBS}) AS churned,
       {PCT(f'COUNT(*) FILTER (seen <= {OBS})', 'COUNT(*)')} AS churn_rate_pct,
       {R2('CAST(SUM(spent) AS DOUBLE) / COUNT(*)')} AS avg_revenue
FROM shares GROUP BY share""")

register("churn_by_country", f"""
places AS (SELECT DISTINCT country, customer_id, MIN(invoice_ts) OVER here AS born, MAX(invoice_ts) OVER here AS seen
           FROM tx WINDOW here AS (PARTITION BY country, customer_id))
SELECT country AS "Country", COUNT(*) AS customers, COUNT(*) FILTER (seen <= {OBS}) AS churned,
       {PCT(f'COUNT(*) FILTER (seen <= {OBS})', 'COUNT(*)')} AS churn_rate_pct
FROM places WHERE born <= {OBS} GROUP BY country HAVING COUNT(*) >= 50""")

register("lifetime_distribution", f"""
{PEOPLE},
{ranges('life', [('0-7 days', 7), ('8-30 days', 30), ('31-60 days', 60), ('61-90 days', 90), ('91-180 days', 180), ('181-365 days', 365),
                 ('365+ days', None)])}
SELECT label AS lifetime_bucket, COUNT(*) AS total_customers, {PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_churned
FROM people JOIN life ON {within(FRAC('seen', 'born'))} WHERE seen <= {OBS} GROUP BY label""")

register("churn_by_customer_type", f"""
{PEOPLE},
{ranges('kind', [('One-time', 1), ('Low-repeat (2-3)', 3), ('Medium-repeat (4-5)', 5), ('High-repeat (6+)', None)])}
SELECT label AS customer_type, COUNT(*) AS customers, COUNT(*) FILTER (seen <= {DORMANT}) AS churned,
       COUNT(*) FILTER (seen > {DORMANT}) AS active, {PCT(f'COUNT(*) FILTER (seen <= {DORMANT})', 'COUNT(*)')} AS churn_rate_pct
FROM people JOIN kind ON {within('orders')} GROUP BY label""")

register("churn_by_acquisition_season", f"""
{PEOPLE}
SELECT ['Winter', 'Spring', 'Summer', 'Fall'][month(born) % 12 // 3 + 1] AS acquisition_season, COUNT(*) AS customers,
       {R2('CAST(SUM(orders) AS DOUBLE) / COUNT(*)')} AS avg_orders, COUNT(*) FILTER (seen <= {DORMANT}) AS churned,
       {PCT(f'COUNT(*) FILTER (seen <= {DORMANT})', 'COUNT(*)')} AS churn_rate_pct
FROM people WHERE born <= {ACQ} GROUP BY 1""")



def second_purchase(src: str, acquired: str, dormant: str) -> str:
    return f"""
{ranges('wait', [('0-7 days', 7), ('8-14 days', 14), ('15-30 days', 30), ('31-60 days', 60), ('60+ days', None)])},
visits AS (
  SELECT list_sort(list(DISTINCT struct_pack(at := invoice_ts, no := invoice))) AS v, MAX(invoice_ts) AS seen FROM {src} GROUP BY customer_id
)
SELECT coalesce(label, 'No second purchase') AS time_to_second_bucket, COUNT(*) AS customers, COUNT(*) FILTER (seen <= {dormant}) AS churned,
       {PCT(f'COUNT(*) FILTER (seen <= {dormant})', 'COUNT(*)')} AS churn_rate_pct
FROM visits LEFT JOIN wait ON {within(FRAC('v[2].at', 'v[1].at'))} WHERE v[1].at <= {acquired} GROUP BY 1"""


register("time_to_second_purchase", second_purchase("tx", ACQ, DORMANT))

# ---------------------------------------------------------------- cohorts
register("cohort_retention", f"""
active AS (SELECT customer_id, date_trunc('month', invoice_ts)::DATE AS m FROM tx GROUP BY ALL),
joined AS (SELECT m, MIN(m) OVER (PARTITION BY customer_id) AS cohort_month FROM active),
counted AS (SELECT cohort_month, date_diff('month', cohort_month, m)::INTEGER AS months_since_join, COUNT(*) AS active_customers
            FROM joined GROUP BY ALL),
sized AS (SELECT *, MAX(active_customers) FILTER (months_since_join = 0) OVER (PARTITION BY cohort_month) AS cohort_size FROM counted)
SELECT cohort_month, cohort_size, months_since_join, active_customers, {PCT('active_customers', 'cohort_size')} AS retention_rate_pct
FROM sized WHERE months_since_join <= 12""")

register("cohort_value", f"""
{PEOPLE}
SELECT date_trunc('month', born)::DATE AS cohort_month, COUNT(*) AS cohort_size,
       {R2('CAST(SUM(spent) AS DOUBLE) / COUNT(*)')} AS avg_customer_revenue, {R2('CAST(SUM(spent) AS DOUBLE)')} AS total_cohort_revenue,
       {R2('CAST(SUM(orders) AS DOUBLE) / COUNT(*)')} AS avg_orders_per_customer,
       {R2('AVG(CAST(spent AS DOUBLE) / lines)')} AS avg_transaction_value
FROM people GROUP BY 1""")

# ---------------------------------------------------------------- activity decline
register("activity_windows_churned", f"""
{PEOPLE},
{ranges('span', [('Last 30 days', 30), ('31-60 days before', 60), ('61-90 days before', 90), ('91-120 days before', 120),
                 ('120+ days before', None)])}
SELECT label AS time_window, COUNT(DISTINCT customer_id) AS unique_customers, COUNT(DISTINCT invoice) AS total_orders,
       {R2('CAST(COUNT(DISTINCT invoice) AS DOUBLE) / COUNT(DISTINCT customer_id)')} AS orders_per_customer
FROM tx JOIN people USING (customer_id) JOIN span ON {within(FRAC('seen', 'invoice_ts'))} WHERE seen <= {OBS} GROUP BY label""")

register("revenue_windows_churned", f"""
{PEOPLE},
{ranges('span', [('Last 30 days', 30), ('31-60 days before', 60), ('61-90 days before', 90), ('90+ days before', None)])},
moments AS (SELECT customer_id, invoice_ts, SUM({LV}) AS worth FROM tx GROUP BY ALL)
SELECT label AS time_window, COUNT(*) AS purchase_days, {R2('CAST(SUM(worth) AS DOUBLE)')} AS total_revenue,
       {R2('CAST(SUM(worth) AS DOUBLE) / COUNT(*)')} AS avg_daily_revenue,
       {R2('quantile_cont(CAST(worth AS DOUBLE), 0.5)')} AS median_daily_revenue
FROM moments JOIN people USING (customer_id) JOIN span ON {within(FRAC('seen', 'invoice_ts'))} WHERE seen <= {OBS} GROUP BY label""")

register("purchase_gaps", f"""
{PEOPLE},
days AS (SELECT DISTINCT customer_id, invoice_ts::DATE AS day FROM tx),
steps AS (SELECT customer_id, date_diff('day', LAG(day) OVER (PARTITION BY customer_id ORDER BY day), day)::DOUBLE AS gap FROM days)
SELECT {status('seen', OBS)} AS status, {R2('SUM(gap) / COUNT(gap)')} AS avg_days_between_orders,
       {R2('quantile_cont(gap, 0.5)')} AS median_days_between_orders, MIN(gap) AS min_gap, MAX(gap) AS max_gap, COUNT(gap) AS total_gaps
FROM steps JOIN people USING (customer_id) GROUP BY 1 HAVING COUNT(gap) > 0""")

register("recent_vs_historical_order_value", f"""
bills AS (SELECT customer_id, invoice, invoice_ts, SUM({LV}) AS worth FROM tx GROUP BY ALL),
histories AS (
  SELECT list(worth ORDER BY invoice_ts DESC, invoice DESC) AS w, MAX(invoice_ts) AS seen FROM bills GROUP BY customer_id HAVING COUNT(*) >= 6
), halves AS (
  SELECT seen, CAST(list_sum(w[1:3]) AS DOUBLE) / 3 AS late, CAST(list_sum(w[4:]) AS DOUBLE) / (len(w) - 3) AS before FROM histories
)
SELECT {status('seen', OBS)} AS status, COUNT(*) AS customers, {R2('AVG(late)')} AS avg_last_3_orders,
       {R2('AVG(before)')} AS avg_historical_orders,
       {R2('100.0::DOUBLE * (AVG(late) - AVG(before)) / NULLIF(AVG(before), 0)')} AS pct_change
FROM halves GROUP BY 1""")

register("product_diversity_shift", f"""
{PEOPLE},
kinds AS (
  SELECT COUNT(DISTINCT stock_code) FILTER ({FRAC('seen', 'invoice_ts')} <= 60) AS "Last 60 days",
         COUNT(DISTINCT stock_code) FILTER ({FRAC('seen', 'invoice_ts')} > 60) AS "Historical"
  FROM tx JOIN people USING (customer_id) WHERE seen <= {OBS} GROUP BY customer_id
), tall AS (UNPIVOT kinds ON "Last 60 days", "Historical" INTO NAME period VALUE n)
SELECT period, COUNT(*) AS customers, {R2('CAST(SUM(n) AS DOUBLE) / COUNT(*)')} AS avg_unique_products,
       {R2('quantile_cont(CAST(n AS DOUBLE), 0.5)')} AS median_unique_products
FROM tall WHERE n > 0 GROUP BY period""")

# ---------------------------------------------------------------- behavioural patterns
register("rfm_cells", f"""
known AS (
  SELECT customer_id, MAX(invoice_ts) AS seen, COUNT(DISTINCT invoice) AS orders, SUM({LV}) AS spent
  FROM tx WHERE invoice_ts <= {OBS} GROUP BY customer_id HAVING MIN(invoice_ts) <= {DORMANT}
), scored AS (
  SELECT {tile(5, 'seen, customer_id')} AS r, {tile(5, 'orders, customer_id')} AS f, {tile(5, 'spent, customer_id')} AS m,
         {FRAC(OBS, 'seen')} > 60 AS gone
  FROM known
)
SELECT r::INTEGER AS "R_score", f::INTEGER AS "F_score", m::INTEGER AS "M_score", COUNT(*) AS customers,
       COUNT(*) FILTER (gone) AS churned, {PCT('COUNT(*) FILTER (gone)', 'COUNT(*)')} AS churn_rate_pct
FROM scored GROUP BY ALL HAVING COUNT(*) >= 20 ORDER BY churn_rate_pct DESC, 1, 2, 3 LIMIT 20""")


def purchase_times(src: str, until: str, dormant: str) -> str:
    return f"""
habits AS (
  SELECT MAX(invoice_ts) AS seen, COUNT(*) FILTER (isodow(invoice_ts) > 5)::DOUBLE / COUNT(*) AS weekend,
         SUM(hour(invoice_ts))::DOUBLE / COUNT(*) AS mean_hour, COUNT(*) FILTER (hour(invoice_ts) < 12)::DOUBLE / COUNT(*) AS morning
  FROM {src} WHERE invoice_ts <= {until} GROUP BY customer_id
)
SELECT {status('seen', dormant)} AS status, COUNT(*) AS customers, {R2('AVG(weekend) * 100')} AS avg_weekend_pct,
       {R2('AVG(mean_hour)')} AS avg_purchase_hour, {R2('AVG(morning) * 100')} AS avg_morning_pct
FROM habits GROUP BY 1"""


register("purchase_time_patterns", purchase_times("tx", OBS, DORMANT))

register("basket_patterns", f"""
bills AS (
  SELECT customer_id, invoice_ts, struct_pack(kinds := COUNT(DISTINCT stock_code), pieces := SUM(quantity), worth := SUM({LV})) AS b
  FROM tx WHERE invoice_ts <= {OBS} GROUP BY customer_id, invoice, invoice_ts
), shoppers AS (
  SELECT MAX(invoice_ts) AS seen, SUM(b.kinds)::DOUBLE / COUNT(*) AS kinds, SUM(b.pieces) / COUNT(*) AS pieces,
         CAST(SUM(b.worth) AS DOUBLE) / COUNT(*) AS worth, STDDEV_SAMP(CAST(b.worth AS DOUBLE)) AS spread
  FROM bills GROUP BY customer_id
)
SELECT {status('seen', DORMANT)} AS status, COUNT(*) AS customers, {R2('AVG(kinds)')} AS avg_unique_items_per_basket,
       {R2('AVG(pieces)')} AS avg_total_items_per_basket, {R2('AVG(worth)')} AS avg_basket_value,
       {R2('AVG(spread)')} AS basket_value_consistency
FROM shoppers GROUP BY 1""")

register("seasonality_q4", f"""
bought AS (SELECT customer_id, invoice, month(invoice_ts) AS m, MAX(invoice_ts) AS moment FROM tx WHERE invoice_ts <= {OBS} GROUP BY ALL),
years AS (SELECT MAX(moment) AS seen, COUNT(*) FILTER (m >= 10) * 1.0::DOUBLE / COUNT(*) AS autumn, COUNT(DISTINCT m) AS months
          FROM bought GROUP BY customer_id)
SELECT {status('seen', DORMANT)} AS status, COUNT(*) AS customers, {R2('AVG(autumn) * 100')} AS avg_q4_concentration_pct,
       {R2('CAST(SUM(months) AS DOUBLE) / COUNT(*)')} AS avg_active_months
FROM years GROUP BY 1""")

for _key, _src in (("return_behavior", "tx"), ("return_behavior_raw", "retail_raw")):
    register(_key, f"""
given_back AS (SELECT MAX(invoice_ts) AS seen, COUNT(*) FILTER (quantity < 0) AS n, COUNT(*)::DOUBLE AS lines FROM {_src} GROUP BY customer_id)
SELECT {status('seen', DORMANT)} AS status, COUNT(*) AS customers, {R2('AVG(n / lines) * 100')} AS avg_return_rate_pct,
       COUNT(*) FILTER (n > 0) AS customers_with_returns, {PCT('COUNT(*) FILTER (n > 0)', 'COUNT(*)')} AS pct_with_returns
FROM given_back GROUP BY 1""")

register("first_order_quality", f"""
opening AS (
  SELECT *, MIN(invoice_ts) OVER mine AS born, MAX(invoice_ts) OVER mine AS seen
  FROM tx WINDOW mine AS (PARTITION BY customer_id) QUALIFY invoice = MIN(invoice) OVER mine
), baskets AS (
  SELECT seen, COUNT(DISTINCT stock_code) AS kinds, SUM({LV}) AS worth FROM opening WHERE born <= {DORMANT} GROUP BY customer_id, seen
)
SELECT {status('seen', DORMANT)} AS status, COUNT(*) AS customers, {R2('CAST(SUM(kinds) AS DOUBLE) / COUNT(*)')} AS avg_first_order_items,
       {R2('CAST(SUM(worth) AS DOUBLE) / COUNT(*)')} AS avg_first_order_value,
       {R2('quantile_cont(CAST(worth AS DOUBLE), 0.5)')} AS median_first_order_value
FROM baskets GROUP BY 1""")

register("velocity_change", f"""
lives AS (SELECT customer_id, MIN(invoice_ts) AS born, MAX(invoice_ts) AS seen FROM tx WHERE invoice_ts <= {OBS} GROUP BY 1),
pace AS (
  SELECT seen, COUNT(DISTINCT invoice) FILTER ({FRAC('invoice_ts', 'born')} <= 90) AS early,
         COUNT(DISTINCT invoice) FILTER ({FRAC('invoice_ts', 'born')} >= 91 AND {FRAC('invoice_ts', 'born')} <= 180) AS later
  FROM tx JOIN lives USING (customer_id) WHERE invoice_ts <= {OBS} AND {FRAC('seen', 'born')} >= 180 GROUP BY customer_id, seen
)
SELECT {status('seen', DORMANT)} AS status, COUNT(*) AS customers, {R2('CAST(SUM(early) AS DOUBLE) / COUNT(*)')} AS avg_orders_first_90d,
       {R2('CAST(SUM(later) AS DOUBLE) / COUNT(*)')} AS avg_orders_next_90d,
       {R2('CAST(SUM(later) - SUM(early) AS DOUBLE) / COUNT(*)')} AS avg_velocity_change,
       COUNT(*) FILTER (later < early) AS declining_velocity_count, {PCT('COUNT(*) FILTER (later < early)', 'COUNT(*)')} AS pct_declining
FROM pace GROUP BY 1""")

# ---------------------------------------------------------------- data quality (raw table unless noted)
RAW_COLS = ["invoice", "stock_code", "description", "quantity", "invoice_ts", "price", "customer_id", "country"]

register("missing_values", "\nUNION ALL\n".join(
    f"SELECT '{c}' column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) missing_count, "
    f"{PCT(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} missing_pct, CAST(COUNT({c}) AS BIGINT) non_missing FROM retail_raw"
    for c in RAW_COLS))

register("missing_severity", "SELECT column_name, missing_pct, CASE WHEN missing_pct > 10 THEN 'red' "
         "WHEN missing_pct > 1 THEN 'orange' ELSE 'green' END severity FROM (" + "\nUNION ALL\n".join(
             f"SELECT '{c}' column_name, {PCT(f'COUNT(*) - COUNT({c})', 'COUNT(*)')} missing_pct FROM retail_raw"
             for c in RAW_COLS) + ") m")

register("cardinality", "\nUNION ALL\n".join(
    f"SELECT '{c}' column_name, CAST(COUNT(DISTINCT {c}) AS BIGINT) unique_values, "
    f"{PCT(f'COUNT(DISTINCT {c})', 'COUNT(*)')} cardinality_pct FROM retail_raw" for c in RAW_COLS))

register("numeric_describe", "\nUNION ALL\n".join(
    f"SELECT '{c}' column_name, CAST(COUNT({c}) AS BIGINT) count, {R6(f'AVG({c})')} mean, "
    f"{R6(f'STDDEV_SAMP({c})')} std, MIN({c}) min, "
    + ", ".join(f"{R6(f'quantile_cont({c}, {p})')} p{int(round(p * 100))}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    + f", MAX({c}) max FROM retail_raw" for c in ("quantity", "price")))

register("date_range", f"""
SELECT MIN(invoice_ts) start_ts, MAX(invoice_ts) end_ts, {WHOLE('MAX(invoice_ts)', 'MIN(invoice_ts)')} span_days
FROM retail_raw""")

register("daily_volume", f"""
d AS (SELECT CAST(invoice_ts AS DATE) AS day, CAST(COUNT(*) AS BIGINT) transactions FROM retail_raw GROUP BY 1)
SELECT day, transactions, {R2('(SELECT CAST(SUM(transactions) AS DOUBLE) / COUNT(*) FROM d)')} avg_per_day FROM d""")

register("monthly_volume", """
SELECT CAST(date_trunc('month', invoice_ts) AS DATE) AS month, CAST(COUNT(*) AS BIGINT) transactions
FROM retail_raw GROUP BY 1""")

register("out_of_range_dates", f"""
SELECT CAST(COUNT(CASE WHEN invoice_ts > {D(CAL.valid_to)} THEN 1 END) AS BIGINT) future_rows,
       CAST(COUNT(CASE WHEN invoice_ts < {D(CAL.valid_from)} THEN 1 END) AS BIGINT) old_rows
FROM retail_raw""")

_INVALID = [("cancellations", "starts_with(invoice, 'C')"), ("negative_quantity", "quantity < 0"),
            ("non_positive_price", "price <= 0"), ("missing_customer", "customer_id IS NULL")]
register("invalid_transactions", "\nUNION ALL\n".join(
    f"SELECT '{n}' issue, CAST(COUNT(CASE WHEN {p} THEN 1 END) AS BIGINT) \"rows\", "
    f"{PCT(f'COUNT(CASE WHEN {p} THEN 1 END)', 'COUNT(*)')} pct_of_rows FROM retail_raw" for n, p in _INVALID))

register("cancel_negative_overlap", f"""
c AS (SELECT COUNT(CASE WHEN starts_with(invoice, 'C') AND quantity < 0 THEN 1 END) b,
             COUNT(CASE WHEN starts_with(invoice, 'C') THEN 1 END) c,
             COUNT(CASE WHEN quantity < 0 THEN 1 END) q FROM retail_raw)
SELECT CAST(b AS BIGINT) both_rows, CAST(c AS BIGINT) cancellations, CAST(q AS BIGINT) negative_quantity,
       {PCT('b', 'c')} pct_of_cancellations, {PCT('b', 'q')} pct_of_negative FROM c""")

register("special_stock_codes", f"""
sp AS (SELECT stock_code FROM retail_raw WHERE NOT regexp_full_match(stock_code, '\\d+[A-Za-z]?')),
top AS (SELECT stock_code, CAST(COUNT(*) AS BIGINT) transactions FROM sp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
SELECT stock_code, transactions, CAST((SELECT COUNT(*) FROM sp) AS BIGINT) total_special_rows,
       {PCT('(SELECT COUNT(*) FROM sp)', '(SELECT COUNT(*) FROM retail_raw)')} total_special_pct FROM top""")

register("cleaning_waterfall", """
t AS (SELECT customer_id, CASE WHEN customer_id IS NULL THEN 1 WHEN starts_with(invoice, 'C') THEN 2
                  WHEN NOT quantity > 0 THEN 3 WHEN NOT price > 0 THEN 4
                  WHEN stock_code IN ('POST','D','M','BANK CHARGES','PADS','DOT','CRUK','C2','AMAZONFEE') THEN 5
                  ELSE 0 END f FROM retail_raw),
c AS (SELECT COUNT(*) n, COUNT(DISTINCT CASE WHEN f = 0 THEN customer_id END) cc,
             COUNT(CASE WHEN f=1 THEN 1 END) f1, COUNT(CASE WHEN f=2 THEN 1 END) f2, COUNT(CASE WHEN f=3 THEN 1 END) f3,
             COUNT(CASE WHEN f=4 THEN 1 END) f4, COUNT(CASE WHEN f=5 THEN 1 END) f5 FROM t)
SELECT * FROM (
  SELECT 1 step, 'has_customer' rule, CAST(n - f1 AS BIGINT) rows_after, CAST(f1 AS BIGINT) rows_removed, CAST(n AS BIGINT) rows_input, CAST(cc AS BIGINT) clean_customers FROM c
  UNION ALL SELECT 2, 'not_cancelled', n - f1 - f2, f2, n, cc FROM c
  UNION ALL SELECT 3, 'positive_quantity', n - f1 - f2 - f3, f3, n, cc FROM c
  UNION ALL SELECT 4, 'positive_price', n - f1 - f2 - f3 - f4, f4, n, cc FROM c
  UNION ALL SELECT 5, 'not_service_code', n - f1 - f2 - f3 - f4 - f5, f5, n, cc FROM c)""")

register("quality_report", f"""
d AS (SELECT COUNT(*) - COUNT(DISTINCT (invoice, stock_code, description, quantity, invoice_ts, price, customer_id, country)) dup
      FROM tx)
SELECT CAST(COUNT(*) AS BIGINT) transactions, CAST(COUNT(DISTINCT customer_id) AS BIGINT) customers,
       CAST(COUNT(DISTINCT stock_code) AS BIGINT) products, CAST(COUNT(DISTINCT invoice) AS BIGINT) invoices,
       CAST(COUNT(DISTINCT country) AS BIGINT) countries, CAST(MIN(invoice_ts) AS DATE) start_date,
       CAST(MAX(invoice_ts) AS DATE) end_date, {WHOLE('MAX(invoice_ts)', 'MIN(invoice_ts)')} duration_days,
       CAST(SUM((invoice IS NULL)::INT + (stock_code IS NULL)::INT + (description IS NULL)::INT + (quantity IS NULL)::INT
                + (invoice_ts IS NULL)::INT + (price IS NULL)::INT + (customer_id IS NULL)::INT + (country IS NULL)::INT) AS BIGINT) missing_cells,
       CAST((SELECT dup FROM d) AS BIGINT) duplicate_rows
FROM tx""")

register("sample_rows", """
SELECT * FROM retail_raw
ORDER BY invoice_ts, invoice, stock_code, customer_id NULLS FIRST, quantity, price, description NULLS FIRST, country
LIMIT 10""")

register("clean_transactions", "SELECT * FROM tx")

# ---------------------------------------------------------------- exploratory analyses
ES = f"""
cs AS (SELECT customer_id, MIN(invoice_ts) fp, MAX(invoice_ts) lp, COUNT(DISTINCT invoice) total_orders,
              CAST(SUM({LV}) AS DOUBLE) total_revenue, SUM(quantity) total_items,
              {WHOLE('MAX(invoice_ts)', 'MIN(invoice_ts)')} tenure_days
       FROM tx GROUP BY customer_id),
es AS (SELECT *, CASE WHEN lp <= {ELIG} THEN 1 ELSE 0 END is_churned,
              CASE WHEN lp <= {ELIG} THEN 'Churned' ELSE 'Active' END status,
              total_revenue / total_orders avg_order_value,
              total_orders / (greatest(tenure_days, 1) / 30.0::DOUBLE) orders_per_month
       FROM cs WHERE fp <= {ELIG})"""

register("customer_summary", f"""
SELECT customer_id, MIN(invoice_ts) first_purchase, MAX(invoice_ts) last_purchase,
       CAST(COUNT(DISTINCT invoice) AS BIGINT) total_orders, CAST(SUM({LV}) AS DOUBLE) total_revenue,
       SUM(quantity) total_items, {WHOLE('MAX(invoice_ts)', 'MIN(invoice_ts)')} tenure_days
FROM tx GROUP BY customer_id""")

register("churn_flag_last_purchase", f"""{ES}
SELECT CAST(COUNT(*) AS BIGINT) total_customers, CAST(SUM(is_churned) AS BIGINT) churned_customers,
       CAST(COUNT(*) - SUM(is_churned) AS BIGINT) active_customers, {PCT('SUM(is_churned)', 'COUNT(*)')} churn_rate_pct
FROM es""")

register("churn_by_order_bucket", f"""{ES},
dim AS (SELECT * FROM (VALUES ('1 order', 1), ('2-3 orders', 2), ('4-5 orders', 3), ('6-10 orders', 4), ('10+ orders', 5)) d(order_bucket, o)),
g AS (SELECT CASE WHEN total_orders <= 1 THEN '1 order' WHEN total_orders <= 3 THEN '2-3 orders'
                  WHEN total_orders <= 5 THEN '4-5 orders' WHEN total_orders <= 10 THEN '6-10 orders'
                  ELSE '10+ orders' END order_bucket, COUNT(*) customers, SUM(is_churned) churned
      FROM es GROUP BY 1)
SELECT dim.order_bucket, CAST(COALESCE(customers, 0) AS BIGINT) customers, CAST(COALESCE(churned, 0) AS BIGINT) churned,
       {PCT('churned', 'customers')} churn_rate_pct
FROM dim LEFT JOIN g ON dim.order_bucket = g.order_bucket""")

register("activity_windows", f"""{ES},
l AS (SELECT t.customer_id, t.invoice, {LV.replace('quantity', 't.quantity').replace('price', 't.price')} lv, es.status,
             CASE WHEN {WHOLE('es.lp', 't.invoice_ts')} <= 30 THEN 'Last 30 days'
                  WHEN {WHOLE('es.lp', 't.invoice_ts')} <= 60 THEN '31-60 days before'
                  WHEN {WHOLE('es.lp', 't.invoice_ts')} <= 90 THEN '61-90 days before'
                  ELSE '90+ days before' END time_window
      FROM tx t JOIN es ON t.customer_id = es.customer_id)
SELECT status customer_type, time_window, CAST(COUNT(DISTINCT customer_id) AS BIGINT) unique_customers,
       CAST(COUNT(DISTINCT invoice) AS BIGINT) total_orders, {R2('CAST(SUM(lv) AS DOUBLE)')} total_revenue,
       {R2('CAST(COUNT(DISTINCT invoice) AS DOUBLE) / COUNT(DISTINCT customer_id)')} orders_per_customer,
       {R2('CAST(SUM(lv) AS DOUBLE) / COUNT(DISTINCT customer_id)')} revenue_per_customer
FROM l GROUP BY 1, 2""")

register("status_comparison", f"""{ES}
SELECT status, CAST(COUNT(*) AS BIGINT) customers, {R2('CAST(SUM(total_orders) AS DOUBLE) / COUNT(*)')} avg_orders,
       {R2('MEDIAN(CAST(total_orders AS DOUBLE))')} median_orders, {R2('SUM(total_revenue) / COUNT(*)')} avg_revenue,
       {R2('AVG(avg_order_value)')} avg_order_value, {R2('CAST(SUM(tenure_days) AS DOUBLE) / COUNT(*)')} avg_tenure_days,
       {R2('AVG(orders_per_month)')} avg_orders_per_month
FROM es GROUP BY status""")


def _hist_sql(expr: str, bins: int, group: str, where: str = "TRUE") -> str:
    return f"""{ES},
v AS (SELECT {group} grp, CAST({expr} AS DOUBLE) x FROM es WHERE {where} AND {expr} IS NOT NULL),
e AS (SELECT grp, MIN(x) mn, MAX(x) mx, COUNT(*) n FROM v GROUP BY grp),
e2 AS (SELECT grp, n, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END hi FROM e),
c AS (SELECT v.grp, least(CAST(floor((x - lo) * ({float(bins)}::DOUBLE / (hi - lo))) AS INTEGER), {bins - 1}) bin, COUNT(*) cnt
      FROM v JOIN e2 ON v.grp = e2.grp GROUP BY 1, 2),
grid AS (SELECT grp, n, lo, hi, CAST(b AS INTEGER) bin FROM e2, range(0, {bins}) r(b))
SELECT grid.grp "group", grid.bin, {R6(f'lo + grid.bin * ((hi - lo) / {float(bins)}::DOUBLE)')} bin_start,
       {R6(f'lo + (grid.bin + 1) * ((hi - lo) / {float(bins)}::DOUBLE)')} bin_end,
       CAST(COALESCE(cnt, 0) AS BIGINT) count,
       {R6(f'COALESCE(cnt, 0) / (n * ((hi - lo) / {float(bins)}::DOUBLE))')} density
FROM grid LEFT JOIN c ON grid.grp = c.grp AND grid.bin = c.bin"""


for _suffix, _metric, _upper, _bins in (("orders", "total_orders", 20, 20), ("revenue", "total_revenue", 2000, 30),
                                         ("order_value", "avg_order_value", 500, 30), ("tenure", "tenure_days", None, 30)):
    _expr = f"least(CAST({_metric} AS DOUBLE), {float(_upper)}::DOUBLE)" if _upper is not None else _metric
    register(f"histogram_{_suffix}", _hist_sql(_expr, _bins, "status"))
register("histogram_churned_lifetime", _hist_sql("tenure_days", 50, "'all'", "is_churned = 1"))

_MW = ["total_orders", "total_revenue", "avg_order_value", "tenure_days"]
MW_CTE = f"""{ES},
lg AS ({' UNION ALL '.join(f"SELECT '{m}' metric, is_churned, CAST({m} AS DOUBLE) value FROM es WHERE {m} IS NOT NULL" for m in _MW)}),
rk AS (SELECT metric, is_churned, value,
              RANK() OVER (PARTITION BY metric ORDER BY value) + (COUNT(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE midrank
       FROM lg),
ti AS (SELECT metric, SUM(POWER(t, 3) - t) ties FROM (SELECT metric, value, COUNT(*) t FROM lg GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT metric, SUM(CASE WHEN is_churned = 1 THEN midrank ELSE 0 END) r1,
              CAST(SUM(is_churned) AS DOUBLE) n1, CAST(COUNT(*) AS DOUBLE) n,
              AVG(CASE WHEN is_churned = 1 THEN value END) cm, AVG(CASE WHEN is_churned = 0 THEN value END) am
       FROM rk GROUP BY metric),
u AS (SELECT st.*, ti.ties, r1 - n1 * (n1 + 1) / 2.0 u1, n - n1 n2 FROM st JOIN ti USING (metric)),
mw AS (SELECT metric, CAST(n1 AS BIGINT) n_churned, CAST(n2 AS BIGINT) n_active, {R6('cm')} churned_mean, {R6('am')} active_mean,
       {R6('u1')} u_statistic,
       {R6('(greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1))))')} z_score
       FROM u)"""
register("mann_whitney_u", f"{MW_CTE}\nSELECT * FROM mw")
# the published fit of erfc in nested form, from its last coefficient inwards
_FIT = "0.17087277::DOUBLE"
for _c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"):
    _FIT = f"({_FIT} * t + ({_c}::DOUBLE))"
register("mann_whitney_p_values", f"""{MW_CTE},
w AS (SELECT *, abs(z_score) / sqrt(2.0::DOUBLE) x FROM mw), w2 AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * x) t FROM w),
w3 AS (SELECT *, least(1.0::DOUBLE, t * exp({_FIT} - x * x)) p FROM w2)
SELECT * EXCLUDE (x, t, p), {R6('p')} p_value, CASE WHEN p > 0 THEN CAST(floor(log10(p)) AS INTEGER) END p_exponent, p < 0.05 significant FROM w3""")

register("time_to_churn", f"""{ES},
c AS (SELECT tenure_days, {WHOLE(ELIG, 'lp')} inact FROM es WHERE is_churned = 1)
SELECT CAST(COUNT(*) AS BIGINT) churned_customers, {R2('CAST(SUM(tenure_days) AS DOUBLE) / COUNT(*)')} mean_lifetime_days,
       {R2('MEDIAN(CAST(tenure_days AS DOUBLE))')} median_lifetime_days, {R2('STDDEV_SAMP(CAST(tenure_days AS DOUBLE))')} std_lifetime_days,
       {R2('CAST(SUM(inact) AS DOUBLE) / COUNT(*)')} mean_inactive_days, {R2('MEDIAN(CAST(inact AS DOUBLE))')} median_inactive_days,
       {PCT('COUNT(CASE WHEN tenure_days <= 30 THEN 1 END)', 'COUNT(*)')} pct_within_30_days
FROM c""")

register("lifetime_buckets_cut", f"""{ES},
c AS (SELECT tenure_days FROM es WHERE is_churned = 1),
dim AS (SELECT * FROM (VALUES ('0-7d', 1), ('8-30d', 2), ('31-60d', 3), ('61-90d', 4), ('91-180d', 5), ('181-365d', 6), ('365d+', 7)) d(lifetime_bucket, o)),
g AS (SELECT CASE WHEN tenure_days <= 7 THEN '0-7d' WHEN tenure_days <= 30 THEN '8-30d' WHEN tenure_days <= 60 THEN '31-60d'
                  WHEN tenure_days <= 90 THEN '61-90d' WHEN tenure_days <= 180 THEN '91-180d' WHEN tenure_days <= 365 THEN '181-365d'
                  ELSE '365d+' END lifetime_bucket, COUNT(*) customers
      FROM c WHERE tenure_days > 0 GROUP BY 1)
SELECT dim.lifetime_bucket, CAST(COALESCE(customers, 0) AS BIGINT) customers,
       {PCT('COALESCE(customers, 0)', '(SELECT COUNT(*) FROM c)')} pct_of_churned
FROM dim LEFT JOIN g ON dim.lifetime_bucket = g.lifetime_bucket""")

OBSF = f"""
of0 AS (SELECT customer_id, MAX(invoice_ts) last_purchase, MIN(invoice_ts) first_purchase,
               COUNT(DISTINCT invoice) total_orders, COUNT(invoice) total_transactions,
               COUNT(DISTINCT stock_code) unique_products, SUM(quantity) total_quantity,
               SUM(quantity) / COUNT(quantity) avg_quantity, CAST(SUM({LV}) AS DOUBLE) total_revenue
        FROM tx WHERE invoice_ts <= {OBS} GROUP BY customer_id),
of1 AS (SELECT *, total_transactions / total_orders avg_items_per_transaction,
               {WHOLE(OBS, 'last_purchase')} recency_days, {WHOLE('last_purchase', 'first_purchase')} tenure_days,
               total_revenue / total_orders avg_order_value
        FROM of0),
obsf AS (SELECT *, total_orders / (greatest(tenure_days, 1) / 30.0::DOUBLE) orders_per_month,
                CAST(recency_days > 60 AS INTEGER) is_churned
         FROM of1 WHERE first_purchase <= {ELIG})"""

register("observation_features", f"""{OBSF}
SELECT customer_id, last_purchase, first_purchase, CAST(total_orders AS BIGINT) total_orders,
       CAST(total_transactions AS BIGINT) total_transactions, CAST(unique_products AS BIGINT) unique_products,
       total_quantity, avg_quantity, total_revenue, avg_items_per_transaction, recency_days, tenure_days,
       avg_order_value, orders_per_month, is_churned
FROM obsf""")

_OF = ["recency_days", "tenure_days", "total_orders", "total_transactions", "unique_products", "total_quantity",
       "total_revenue", "avg_order_value", "orders_per_month", "avg_items_per_transaction"]
register("target_correlation", f"""{OBSF}
{' UNION ALL '.join(f"SELECT '{c}' feature, {R6(f'corr(CAST({c} AS DOUBLE), CAST(is_churned AS DOUBLE))')} correlation FROM obsf" for c in _OF)}""")

_OFC = _OF + ["is_churned"]
register("correlation_matrix", f"""{OBSF}
{' UNION ALL '.join(f"SELECT '{_OFC[i]}' feature_a, '{_OFC[j]}' feature_b, {R6(f'corr(CAST({_OFC[i]} AS DOUBLE), CAST({_OFC[j]} AS DOUBLE))')} correlation FROM obsf" for i in range(len(_OFC)) for j in range(i))}""")

register("eda_summary", f"""{ES},
b AS (SELECT CASE WHEN total_orders <= 1 THEN 'one' WHEN total_orders > 10 THEN 'ten' ELSE 'mid' END k,
             COUNT(*) n, SUM(is_churned) c FROM es GROUP BY 1)
SELECT {PCT('SUM(is_churned)', 'COUNT(*)')} churn_rate_pct,
       (SELECT {PCT('c', 'n')} FROM b WHERE k = 'one') one_time_churn_rate_pct,
       (SELECT {PCT('c', 'n')} FROM b WHERE k = 'ten') ten_plus_churn_rate_pct,
       {R2('MEDIAN(CASE WHEN is_churned = 1 THEN CAST(tenure_days AS DOUBLE) END)')} median_churned_lifetime_days,
       {PCT('COUNT(CASE WHEN is_churned = 1 AND tenure_days <= 30 THEN 1 END)', 'SUM(is_churned)')} pct_churned_within_30_days
FROM es""")

# ---------------------------------------------------------------- features (lines up to obs)
FE_CTES = f"""
h AS (SELECT * FROM tx WHERE invoice_ts <= {OBS}),
sp AS (SELECT customer_id, MIN(invoice_ts) f, MAX(invoice_ts) l FROM h GROUP BY 1),
fr AS (SELECT customer_id, {WHOLE(OBS, 'l')} recency_days, {WHOLE(OBS, 'f')} tenure_days,
              {WHOLE('l', 'f')} active_period_days,
              {WHOLE(OBS, 'l')} / greatest({WHOLE(OBS, 'f')}, 1) recency_ratio,
              CAST({WHOLE(OBS, 'l')} <= 30 AS INTEGER) is_recent_30d
       FROM sp),
dd AS (SELECT DISTINCT customer_id, CAST(invoice_ts AS DATE) d FROM h),
dg AS (SELECT customer_id, CAST(d - LAG(d) OVER (PARTITION BY customer_id ORDER BY d) AS DOUBLE) gap FROM dd),
ds AS (SELECT customer_id, COUNT(*) active_days, STDDEV_SAMP(gap) istd FROM dg GROUP BY 1),
ff AS (SELECT c.customer_id, CAST(COUNT(DISTINCT invoice) AS BIGINT) total_orders, CAST(COUNT(invoice) AS BIGINT) total_transactions,
              CAST(ANY_VALUE(ds.active_days) AS BIGINT) active_days,
              COUNT(DISTINCT invoice) / greatest({WHOLE(OBS, 'MIN(invoice_ts)')} / 30.0::DOUBLE, 0.5::DOUBLE) orders_per_month,
              {WHOLE('MAX(invoice_ts)', 'MIN(invoice_ts)')} / greatest(COUNT(DISTINCT invoice) - 1, 1) avg_days_between_orders,
              COALESCE({R6('ANY_VALUE(ds.istd)')}, 0.0) purchase_interval_std,
              CAST(COUNT(DISTINCT invoice) = 1 AS INTEGER) is_single_order
       FROM h c JOIN ds ON c.customer_id = ds.customer_id GROUP BY c.customer_id),
ov AS (SELECT customer_id, invoice, SUM({LV}) v, SUM(quantity) q, COUNT(DISTINCT stock_code) items FROM h GROUP BY 1, 2),
fm0 AS (SELECT customer_id, SUM(v) rev, COUNT(*) n, MAX(v) mx, MIN(v) mn, STDDEV_SAMP(CAST(v AS DOUBLE)) sd,
               SUM(q) total_quantity, SUM(items) it FROM ov GROUP BY 1),
fm AS (SELECT fm0.customer_id, CAST(rev AS DOUBLE) total_revenue, CAST(rev AS DOUBLE) / n avg_order_value,
              CAST(mx AS DOUBLE) max_order_value, CAST(mn AS DOUBLE) min_order_value,
              COALESCE({R6('sd')}, 0.0) order_value_std, total_quantity, it / n avg_items_per_order,
              CAST(rev AS DOUBLE) / ds.active_days revenue_per_active_day,
              COALESCE({R6('sd / greatest(CAST(rev AS DOUBLE) / n, 0.01::DOUBLE)')}, 0.0) order_value_cv
       FROM fm0 JOIN ds ON fm0.customer_id = ds.customer_id),
bk AS (SELECT h.customer_id, invoice, invoice_ts, SUM({LV}) v, SUM(quantity) q,
              ANY_VALUE(sp.f) f, ANY_VALUE(sp.l) l
       FROM h JOIN sp ON h.customer_id = sp.customer_id GROUP BY 1, 2, 3),
bk2 AS (SELECT *, 2 * (epoch_us(invoice_ts) - epoch_us(f)) <= epoch_us(l) - epoch_us(f) e,
               invoice_ts > {RECENT} l30, invoice_ts > {ELIG} AND NOT invoice_ts > {RECENT} p30 FROM bk),
iv AS (SELECT customer_id, invoice, MAX(CAST(e AS INTEGER)) ie, MAX(CAST(NOT e AS INTEGER)) ir,
              SUM(CASE WHEN e THEN v ELSE 0 END) re, SUM(CASE WHEN NOT e THEN v ELSE 0 END) rr,
              SUM(CASE WHEN e THEN q ELSE 0.0 END) qe, SUM(CASE WHEN NOT e THEN q ELSE 0.0 END) qr,
              MAX(CAST(l30 AS INTEGER)) il, MAX(CAST(p30 AS INTEGER)) ip,
              SUM(CASE WHEN l30 THEN v ELSE 0 END) rl, SUM(CASE WHEN p30 THEN v ELSE 0 END) rp
       FROM bk2 GROUP BY 1, 2),
tc AS (SELECT customer_id, SUM(ie) ie, SUM(ir) ir, SUM(re) re, SUM(rr) rr, SUM(qe) qe, SUM(qr) qr,
              SUM(il) il, SUM(ip) ip, SUM(rl) rl, SUM(rp) rp FROM iv GROUP BY 1),
ft AS (SELECT customer_id, (ir - ie) / greatest(ie, 1) order_trend,
              CAST(rr - re AS DOUBLE) / greatest(CAST(re AS DOUBLE), 1.0::DOUBLE) revenue_trend,
              (qr - qe) / greatest(qe, 1.0::DOUBLE) quantity_trend,
              CAST((ir - ie) / greatest(ie, 1) < 0 OR CAST(rr - re AS DOUBLE) / greatest(CAST(re AS DOUBLE), 1.0::DOUBLE) < 0 AS INTEGER) is_declining,
              CAST(il AS BIGINT) orders_last30, CAST(rl AS DOUBLE) revenue_last30,
              CAST(il - ip AS BIGINT) recent_order_momentum, CAST(rl - rp AS DOUBLE) recent_revenue_momentum
       FROM tc),
pc AS (SELECT customer_id, stock_code, COUNT(*) n FROM h GROUP BY 1, 2),
pcs AS (SELECT customer_id, COUNT(*) up, MAX(n) mx, SUM(n) sm FROM pc GROUP BY 1),
oi AS (SELECT customer_id, SUM(items) / COUNT(*) apo FROM ov GROUP BY 1),
fe AS (SELECT h.customer_id, CAST(ANY_VALUE(pcs.up) AS BIGINT) unique_products,
              CAST(COUNT(DISTINCT description) AS BIGINT) unique_descriptions, CAST(COUNT(invoice) AS BIGINT) total_line_items,
              ANY_VALUE(oi.apo) avg_products_per_order, ANY_VALUE(pcs.mx) / ANY_VALUE(pcs.sm) product_concentration,
              COALESCE(CAST(FIRST(country ORDER BY invoice_ts, invoice) FILTER (WHERE country IS NOT NULL) = '{CAL.home_country}' AS INTEGER), 0) is_uk
       FROM h JOIN pcs ON h.customer_id = pcs.customer_id JOIN oi ON h.customer_id = oi.customer_id
       GROUP BY h.customer_id)"""

FEATURE_LIST = ["recency_days", "tenure_days", "active_period_days", "recency_ratio", "is_recent_30d",
                "total_orders", "total_transactions", "active_days", "orders_per_month", "avg_days_between_orders",
                "purchase_interval_std", "is_single_order",
                "total_revenue", "avg_order_value", "max_order_value", "min_order_value", "order_value_std",
                "total_quantity", "avg_items_per_order", "revenue_per_active_day", "order_value_cv",
                "order_trend", "revenue_trend", "quantity_trend", "is_declining", "orders_last30", "revenue_last30",
                "recent_order_momentum", "recent_revenue_momentum",
                "unique_products", "unique_descriptions", "total_line_items", "avg_products_per_order",
                "product_concentration", "is_uk"]

for _g, _cte in (("recency", "fr"), ("frequency", "ff"), ("monetary", "fm"), ("trend", "ft"), ("engagement", "fe")):
    register(f"features_{_g}", f"{FE_CTES}\nSELECT * FROM {_cte}")

FM_SELECT = ", ".join(f"COALESCE({c}, 0) {c}" for c in FEATURE_LIST)
FM_CTE = f"""{FE_CTES},
fmx AS (SELECT fr.customer_id, {FM_SELECT}
        FROM fr LEFT JOIN ff USING (customer_id) LEFT JOIN fm USING (customer_id)
                LEFT JOIN ft USING (customer_id) LEFT JOIN fe USING (customer_id))"""
register("feature_matrix", f"{FM_CTE}\nSELECT * FROM fmx")

# ---------------------------------------------------------------- labels and split
LAB_CTE = f"""
lab AS (SELECT customer_id,
               CAST(1 - MAX(CAST(invoice_ts > {OBS} AND invoice_ts <= {PRED_END} AS INTEGER)) AS INTEGER) is_churned
        FROM tx GROUP BY customer_id HAVING MIN(invoice_ts) <= {ELIG})"""

register("future_active_customers", f"SELECT DISTINCT customer_id FROM tx WHERE invoice_ts > {OBS} AND invoice_ts <= {PRED_END}")
register("eligible_customers", f"SELECT customer_id FROM tx GROUP BY customer_id HAVING MIN(invoice_ts) <= {ELIG}")
register("churn_labels", f"{LAB_CTE}\nSELECT * FROM lab")

SNAPSHOTS = [CAL.observation - dt.timedelta(days=60), CAL.observation - dt.timedelta(days=30), CAL.observation]
register("is_churned_at", f"""
sn AS (SELECT CAST(d AS DATE) obs_date, CAST(d AS TIMESTAMP) o FROM (VALUES {', '.join(f"('{d.isoformat()}')" for d in SNAPSHOTS)}) v(d)),
fp AS (SELECT customer_id, MIN(invoice_ts) f FROM tx GROUP BY 1),
el AS (SELECT fp.customer_id, sn.obs_date FROM fp JOIN sn ON fp.f <= sn.o - INTERVAL 60 DAY),
ac AS (SELECT DISTINCT tx.customer_id, sn.obs_date FROM tx JOIN sn ON tx.invoice_ts > sn.o AND tx.invoice_ts <= sn.o + INTERVAL 60 DAY)
SELECT el.obs_date, el.customer_id, CASE WHEN ac.customer_id IS NULL THEN 1 ELSE 0 END is_churned
FROM el LEFT JOIN ac ON el.customer_id = ac.customer_id AND el.obs_date = ac.obs_date""")

register("churn_by_snapshot", f"""
sn AS (SELECT CAST(o AS DATE) obs_date, o FROM range({OBS} - INTERVAL 364 DAY, {OBS} + INTERVAL 1 DAY, INTERVAL 1 DAY) r(o)),
ac AS (SELECT DISTINCT customer_id, o FROM tx JOIN sn ON invoice_ts > o AND invoice_ts <= o + INTERVAL 60 DAY),
el AS (SELECT customer_id, obs_date, o FROM (SELECT customer_id, MIN(invoice_ts) f FROM tx GROUP BY 1) JOIN sn ON f + INTERVAL 60 DAY <= o)
SELECT obs_date, CAST(COUNT(*) AS BIGINT) eligible, CAST(COUNT(*) FILTER (ac.o IS NULL) AS BIGINT) churned,
       {PCT('COUNT(*) FILTER (ac.o IS NULL)', 'COUNT(*)')} churn_rate_pct
FROM el LEFT JOIN ac USING (customer_id, o) GROUP BY obs_date""")

register("label_distribution", f"""{LAB_CTE},
r AS (SELECT COUNT(*) t, SUM(is_churned) c FROM lab)
SELECT CAST(t AS BIGINT) total_customers, CAST(c AS BIGINT) churned, CAST(t - c AS BIGINT) active,
       {PCT('c', 't')} churned_pct, {PCT('t - c', 't')} active_pct,
       {R2('CAST(t - c AS DOUBLE) / NULLIF(CAST(c AS DOUBLE), 0)')} imbalance_ratio,
       COALESCE(CAST(t - c AS DOUBLE) / NULLIF(CAST(c AS DOUBLE), 0) > 3.0, TRUE) needs_rebalancing
FROM r""")

register("leakage_checks", f"""{FM_CTE},{LAB_CTE},
past AS (SELECT customer_id, {WHOLE(OBS, 'MAX(invoice_ts)')} AS days FROM tx WHERE invoice_ts <= {OBS} GROUP BY 1),
future AS (SELECT DISTINCT customer_id FROM tx WHERE invoice_ts > {OBS} AND invoice_ts <= {PRED_END}),
wrong AS (
  SELECT 1 AS check_id, 'recency_not_negative' AS check_name, (SELECT COUNT(*) FROM fmx WHERE recency_days < 0) AS violations
  UNION ALL SELECT 2, 'recency_recomputed', (SELECT COUNT(*) FROM fmx LEFT JOIN past USING (customer_id) WHERE days IS DISTINCT FROM recency_days)
  UNION ALL SELECT 3, 'active_buy_in_label_period', (SELECT COUNT(*) FROM lab WHERE is_churned = 0 AND customer_id NOT IN (FROM future))
  UNION ALL SELECT 4, 'churned_do_not_buy', (SELECT COUNT(*) FROM lab WHERE is_churned = 1 AND customer_id IN (FROM future))
  UNION ALL SELECT 5, 'labels_known_once', (SELECT COUNT(*) FROM (SELECT customer_id FROM lab ANTI JOIN past USING (customer_id) UNION ALL
                                            (SELECT customer_id FROM lab GROUP BY 1 HAVING COUNT(*) > 1))))
SELECT *, violations = 0 AS passed FROM wrong""")

MR_CTE = f"""{FM_CTE},{LAB_CTE},
mr AS (SELECT fmx.*, lab.is_churned FROM fmx JOIN lab USING (customer_id))"""
register("model_ready", f"{MR_CTE}\nSELECT * FROM mr")

SPLIT_CTE = f"""{MR_CTE},
hs AS (SELECT *, (((((customer_id % 4294967296) // 65536) * 2654435761) % 65536) * 65536
                  + ((customer_id % 4294967296) % 65536) * 2654435761) % 4294967296 hh FROM mr),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY is_churned ORDER BY hh, customer_id) - 1 pos,
              COUNT(*) OVER (PARTITION BY is_churned) nc FROM hs),
sp2 AS (SELECT * EXCLUDE (hh, pos, nc),
               CASE WHEN pos < floor(nc * 0.2::DOUBLE + 0.5) THEN 'test'
                    WHEN pos < floor(nc * 0.2::DOUBLE + 0.5) + floor((nc - floor(nc * 0.2::DOUBLE + 0.5)) * 0.2::DOUBLE + 0.5) THEN 'validation'
                    ELSE 'train' END split
        FROM rk)"""
register("stratified_split", f"{SPLIT_CTE}\nSELECT * FROM sp2")
register("split_report", f"""{SPLIT_CTE}
SELECT split, CAST(COUNT(*) AS BIGINT) customers, {PCT('COUNT(*)', '(SELECT COUNT(*) FROM sp2)')} pct_of_customers,
       {PCT('SUM(is_churned)', 'COUNT(*)')} churn_rate_pct
FROM sp2 GROUP BY split""")

# ---------------------------------------------------------------- evaluation on the deterministic heuristic score
SC_CTE = f"""
sh AS (SELECT customer_id, MAX(invoice_ts) l FROM tx WHERE invoice_ts <= {OBS} GROUP BY 1),
scr AS (SELECT customer_id, {WHOLE(OBS, 'l')} recency_days FROM sh),
{LAB_CTE.strip()},
sc AS (SELECT 'recency_heuristic' model, scr.customer_id,
              recency_days / (recency_days + 60.0::DOUBLE) churn_probability, lab.is_churned actual
       FROM scr JOIN lab USING (customer_id))"""


# Four candidate models; the statements on several models read this table in place of the single score.
CANDIDATES_CTE = f"""
sh AS (SELECT customer_id, {WHOLE(OBS, 'MAX(invoice_ts)')} AS age, COUNT(DISTINCT invoice) orders, CAST(SUM({LV}) AS DOUBLE) spent
       FROM tx WHERE invoice_ts <= {OBS} GROUP BY 1),
{LAB_CTE.strip()},
sc AS (SELECT model, customer_id, churn_probability, is_churned actual
       FROM (UNPIVOT (SELECT customer_id, age / (age + 60.0::DOUBLE) recency_heuristic, age / (age + 30.0::DOUBLE) recency_steep,
                             1.0::DOUBLE / orders frequency_heuristic, 1000.0::DOUBLE / (1000.0::DOUBLE + spent) monetary_heuristic FROM sh)
             ON recency_heuristic, recency_steep, frequency_heuristic, monetary_heuristic INTO NAME model VALUE churn_probability)
       JOIN lab USING (customer_id))"""


def on_candidates(body: str) -> str:
    """A statement on the single score, on the candidates instead."""
    assert SC_CTE in body
    return body.replace(SC_CTE, CANDIDATES_CTE)


def _conf(t: str) -> str:
    return (f"CAST(COUNT(*) FILTER (WHERE actual = 0 AND NOT churn_probability >= {t}) AS BIGINT) tn, "
            f"CAST(COUNT(*) FILTER (WHERE actual = 0 AND churn_probability >= {t}) AS BIGINT) fp, "
            f"CAST(COUNT(*) FILTER (WHERE actual = 1 AND NOT churn_probability >= {t}) AS BIGINT) fn, "
            f"CAST(COUNT(*) FILTER (WHERE actual = 1 AND churn_probability >= {t}) AS BIGINT) tp")


def DIV0(a: str, b: str) -> str:
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


CURVE_CTE = f"""{SC_CTE},
pv AS (SELECT model, churn_probability p, CAST(SUM(actual) AS BIGINT) pos, CAST(COUNT(*) - SUM(actual) AS BIGINT) neg
       FROM sc GROUP BY 1, 2),
cu AS (SELECT *, SUM(pos) OVER (PARTITION BY model ORDER BY p DESC) pc, SUM(neg) OVER (PARTITION BY model ORDER BY p DESC) nc
       FROM pv)"""

EVAL_CTE = f"""{CURVE_CTE},
cm AS (SELECT model, {_conf('0.5::DOUBLE')} FROM sc GROUP BY model),
rs AS (SELECT model, SUM(pos) n1, SUM(neg) n0, SUM(pos * nc) s1, SUM(pos * neg) s2,
              SUM(CAST(pos * pc AS DOUBLE) / (pc + nc)) s3 FROM cu GROUP BY model),
ev0 AS (SELECT cm.*, rs.n1, rs.n0, rs.s1, rs.s2, rs.s3, tn + fp + fn + tp n,
               {DIV0('tp', 'tp + fp')} pr, {DIV0('tp', 'tp + fn')} rc FROM cm JOIN rs USING (model)),
ev AS (SELECT model, CAST(n AS BIGINT) n, {R6(DIV0('tp + tn', 'n'))} accuracy, {R6('pr')} "precision", {R6('rc')} recall,
              {R6(DIV0('2 * pr * rc', 'pr + rc'))} f1,
              {R6('(CAST(n1 * n0 AS DOUBLE) - CAST(s1 AS DOUBLE) + 0.5 * CAST(s2 AS DOUBLE)) / NULLIF(CAST(n1 * n0 AS DOUBLE), 0)')} roc_auc,
              {R6('s3 / NULLIF(CAST(n1 AS DOUBLE), 0)')} pr_auc
       FROM ev0)"""

register("heuristic_scores", f"{SC_CTE}\nSELECT * FROM sc")
register("candidate_scores", f"{CANDIDATES_CTE}\nSELECT * FROM sc")
register("evaluate_scores", f"{EVAL_CTE}\nSELECT * FROM ev")
register("model_comparison", on_candidates(f"{EVAL_CTE}\nSELECT * FROM ev"))
register("select_model", on_candidates(f"{EVAL_CTE}\nSELECT * FROM ev ORDER BY roc_auc DESC NULLS LAST, model LIMIT 1"))
register("confusion_matrix", f"{SC_CTE}\nSELECT model, {_conf('0.5::DOUBLE')} FROM sc GROUP BY model")
register("majority_baseline", f"{SC_CTE}\nSELECT model, {R6('1.0::DOUBLE - CAST(SUM(actual) AS DOUBLE) / COUNT(*)')} baseline_accuracy FROM sc GROUP BY model")
register("roc_curve", on_candidates(f"""{CURVE_CTE},
tt AS (SELECT model, SUM(pos) n1, SUM(neg) n0 FROM pv GROUP BY model)
SELECT cu.model, p threshold, {R6('CAST(nc AS DOUBLE) / NULLIF(CAST(n0 AS DOUBLE), 0)')} fpr,
       {R6('CAST(pc AS DOUBLE) / NULLIF(CAST(n1 AS DOUBLE), 0)')} tpr
FROM cu JOIN tt USING (model)
UNION ALL SELECT model, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM tt"""))
register("metric_targets", f"""{EVAL_CTE},
bz AS (SELECT model, {R6('(tp + fp) * 20.0::DOUBLE / NULLIF(tp * 0.4::DOUBLE, 0)')} cpr,
              {R6('tp * 0.4::DOUBLE * 200.0::DOUBLE / NULLIF((tp + fp) * 20.0::DOUBLE, 0)')} iroi FROM cm)
SELECT model, metric, value, target, direction,
       COALESCE(CASE direction WHEN '>=' THEN value >= target WHEN '>' THEN value > target ELSE value < target END, FALSE) passed
FROM (
  SELECT model, 'recall' metric, recall value, 0.75::DOUBLE target, '>=' direction FROM ev
  UNION ALL SELECT model, 'precision', "precision", 0.5::DOUBLE, '>=' FROM ev
  UNION ALL SELECT model, 'roc_auc', roc_auc, 0.8::DOUBLE, '>=' FROM ev
  UNION ALL SELECT model, 'pr_auc', pr_auc, 0.6::DOUBLE, '>=' FROM ev
  UNION ALL SELECT model, 'cost_per_retained_customer', cpr, 50.0::DOUBLE, '<' FROM bz
  UNION ALL SELECT model, 'intervention_roi', iroi, 3.0::DOUBLE, '>' FROM bz)""")

import numpy as _np  # noqa: E402

_TH = [float(x) for x in _np.arange(0.05, 0.95, 0.05)]
_COST = "CAST(tn * 0.0::DOUBLE + fp * 20.0::DOUBLE + fn * 200.0::DOUBLE + tp * -80.0::DOUBLE AS DOUBLE)"
SWEEP_CTE = f"""{SC_CTE},
th AS (SELECT CAST(t AS DOUBLE) threshold FROM (VALUES {', '.join(f'({t!r})' for t in _TH)}) v(t)),
sw AS (SELECT model, threshold, {_conf('threshold')} FROM sc, th GROUP BY model, threshold),
swc AS (SELECT *, {_COST} total_cost, {DIV0('tp', 'tp + fp')} "precision", {DIV0('tp', 'tp + fn')} recall FROM sw),
opt AS (SELECT * FROM swc QUALIFY ROW_NUMBER() OVER (PARTITION BY model ORDER BY total_cost, threshold) = 1),
dft AS (SELECT model, 0.5::DOUBLE threshold, {_conf('0.5::DOUBLE')} FROM sc GROUP BY model),
dfc AS (SELECT *, {_COST} total_cost, {DIV0('tp', 'tp + fp')} "precision", {DIV0('tp', 'tp + fn')} recall FROM dft),
roi AS (SELECT model, threshold, tp churners_caught, fp false_alarms, tp * 0.4::DOUBLE churners_saved,
               tp * 0.4::DOUBLE * 200.0::DOUBLE revenue_saved, (tp + fp) * 20.0::DOUBLE retention_cost,
               tp * 0.4::DOUBLE * 200.0::DOUBLE - (tp + fp) * 20.0::DOUBLE net_benefit,
               {R6('CASE WHEN (tp + fp) * 20.0::DOUBLE > 0 THEN (tp * 0.4::DOUBLE * 200.0::DOUBLE - (tp + fp) * 20.0::DOUBLE) / ((tp + fp) * 20.0::DOUBLE) * 100 ELSE 0.0 END')} roi,
               "precision", recall, total_cost
        FROM opt)"""

register("business_cost", f"{SWEEP_CTE}\nSELECT * FROM dfc")
register("threshold_sweep", f"{SWEEP_CTE}\nSELECT * FROM swc")
register("optimal_threshold", on_candidates(f"{SWEEP_CTE}\nSELECT * FROM opt"))
register("precision_recall_curve", on_candidates(f"""{CURVE_CTE},
tt AS (SELECT model, SUM(pos) n1 FROM pv GROUP BY model)
SELECT cu.model, p threshold, {R6(DIV0('pc', 'pc + nc'))} "precision",
       {R6('CASE WHEN n1 = 0 THEN 1.0 ELSE CAST(pc AS DOUBLE) / n1 END')} recall
FROM cu JOIN tt USING (model)
UNION ALL SELECT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM tt"""))
register("cost_breakdown", f"""{SWEEP_CTE},
b AS (SELECT model, 'default' scenario, threshold, fn, fp, tp FROM dfc UNION ALL SELECT model, 'optimal', threshold, fn, fp, tp FROM opt)
SELECT model, scenario, threshold, 'false_negatives' category, CAST(fn * 200.0 AS DOUBLE) amount FROM b
UNION ALL SELECT model, scenario, threshold, 'false_positives', CAST(fp * 20.0 AS DOUBLE) FROM b
UNION ALL SELECT model, scenario, threshold, 'true_positives', CAST(tp * 80.0 AS DOUBLE) FROM b""")
register("scenario_comparison", on_candidates(f"""{SWEEP_CTE},
bs AS (SELECT model, CAST(SUM(actual) * 200.0 AS DOUBLE) baseline_cost FROM sc GROUP BY model),
r AS (SELECT model, 'no_model' scenario, NULL::DOUBLE threshold, 0::BIGINT churners_caught, 0::BIGINT false_alarms, baseline_cost total_cost FROM bs
      UNION ALL SELECT model, 'default', threshold, tp, fp, total_cost FROM dfc
      UNION ALL SELECT model, 'optimal', threshold, tp, fp, total_cost FROM opt)
SELECT r.*, bs.baseline_cost - r.total_cost savings_vs_no_model,
       CASE WHEN r.scenario = 'optimal' THEN dfc.total_cost - r.total_cost END savings_vs_default
FROM r JOIN bs USING (model) JOIN dfc USING (model)"""))
register("retention_roi", f"{SWEEP_CTE}\nSELECT model, threshold, churners_caught, false_alarms, churners_saved, revenue_saved, retention_cost, net_benefit, roi FROM roi")
register("annual_impact", f"{SWEEP_CTE}\nSELECT model, net_benefit, net_benefit * 5.0 * 4.0 annual_benefit_scaled, net_benefit * 4.0 annual_benefit FROM roi")
CA_CTE = f"""{SWEEP_CTE},
ca AS (SELECT model, threshold optimal_threshold, "precision" precision_at_optimal, recall recall_at_optimal,
              total_cost total_cost_at_optimal, net_benefit, roi, 200.0::DOUBLE cost_fn, 20.0::DOUBLE cost_fp,
              0.4::DOUBLE retention_success_rate FROM roi)"""
register("cost_analysis", f"{CA_CTE}\nSELECT * FROM ca")
register("executive_summary", f"{CA_CTE}\nSELECT model, optimal_threshold, roi, net_benefit, net_benefit * 4.0 annual_benefit FROM ca")
register("impact_scenario", f"""{SWEEP_CTE},
pa AS (SELECT sc.model, COUNT(*) customers, SUM(actual) / COUNT(*) churn_rate FROM sc GROUP BY sc.model),
pp AS (SELECT pa.model, pa.customers, pa.churn_rate, opt.recall, opt.fp false_alarms FROM pa JOIN opt USING (model))
SELECT model, CAST(customers AS BIGINT) customers, churn_rate, recall, false_alarms,
       {R6('customers * churn_rate')} churners, {R6('customers * churn_rate * recall')} churners_caught,
       {R6('customers * churn_rate * recall * 0.4::DOUBLE')} customers_saved,
       {R6('customers * churn_rate * recall * 0.4::DOUBLE * 200.0::DOUBLE')} revenue_retained,
       {R6('(customers * churn_rate * recall + false_alarms) * 20.0::DOUBLE')} intervention_cost,
       {R6('customers * churn_rate * recall * 0.4::DOUBLE * 200.0::DOUBLE - (customers * churn_rate * recall + false_alarms) * 20.0::DOUBLE')} net_benefit
FROM pp""")

SEG_CTE = f"""{SC_CTE},
cseg AS (SELECT customer_id, CASE WHEN churn_probability >= 0.7 THEN 'HIGH_RISK' WHEN churn_probability >= 0.4 THEN 'MEDIUM_RISK'
                                  WHEN churn_probability >= 0.2 THEN 'LOW_RISK' ELSE 'SAFE' END risk_segment,
                churn_probability, actual actual_churned FROM sc),
sg AS (SELECT risk_segment, COUNT(*) customers, SUM(actual_churned) churned FROM cseg GROUP BY 1),
strat AS (SELECT * FROM (VALUES ('HIGH_RISK', 'IMMEDIATE INTERVENTION', 50.0::DOUBLE, 0.25::DOUBLE),
                                ('MEDIUM_RISK', 'PROACTIVE ENGAGEMENT', 20.0::DOUBLE, 0.40::DOUBLE),
                                ('LOW_RISK', 'NURTURE & MONITOR', 5.0::DOUBLE, 0.60::DOUBLE),
                                ('SAFE', 'MAINTAIN RELATIONSHIP', 2.0::DOUBLE, 0.80::DOUBLE)) v(risk_segment, action, cpc, esr)),
bud AS (SELECT sg.risk_segment segment, CAST(customers AS BIGINT) customers, CAST(churned AS BIGINT) expected_churners,
               cpc cost_per_customer, customers * cpc total_cost, esr expected_save_rate,
               churned * esr saved, churned * esr * 200.0::DOUBLE rev, churned * esr * 200.0::DOUBLE - customers * cpc net
        FROM sg JOIN strat USING (risk_segment))"""
register("customer_segments", f"{SEG_CTE}\nSELECT * FROM cseg")
register("segment_summary", f"""{SEG_CTE},
al AS (SELECT risk_segment, customers, churned FROM sg UNION ALL SELECT 'TOTAL', SUM(customers), SUM(churned) FROM sg)
SELECT risk_segment, CAST(customers AS BIGINT) customers, {PCT('customers', '(SELECT SUM(customers) FROM sg)')} pct_of_base,
       CAST(churned AS BIGINT) churned, {PCT('churned', 'customers')} churn_rate_pct FROM al""")
register("segment_budget", f"""{SEG_CTE}
SELECT segment, customers, expected_churners, cost_per_customer, total_cost, expected_save_rate, {R6('saved')} customers_saved,
       {R6('rev')} revenue_saved, {R6('net')} net_benefit, {R6('CASE WHEN total_cost > 0 THEN net / total_cost * 100 ELSE 0.0 END')} roi
FROM bud""")
register("budget_total", f"""{SEG_CTE},
b2 AS (SELECT segment, customers, total_cost, {R6('saved')} customers_saved, {R6('net')} net_benefit FROM bud)
SELECT CAST(SUM(customers) AS BIGINT) customers, SUM(total_cost) total_cost, {R6('SUM(customers_saved)')} customers_saved,
       {R6('SUM(net_benefit)')} net_benefit,
       {R6('CASE WHEN SUM(total_cost) > 0 THEN SUM(net_benefit) / SUM(total_cost) * 100 ELSE 0.0 END')} total_roi FROM b2""")
register("segment_profiles", f"""{SEG_CTE},
{FE_CTES.strip()},
pf AS (SELECT cseg.risk_segment, fr.recency_days, fm.avg_order_value FROM cseg JOIN fr USING (customer_id) JOIN fm USING (customer_id))
SELECT 'recency_days' feature, risk_segment, {R2('AVG(CAST(recency_days AS DOUBLE))')} mean FROM pf GROUP BY risk_segment
UNION ALL SELECT 'avg_order_value', risk_segment, {R2('AVG(avg_order_value)')} FROM pf GROUP BY risk_segment""")
register("histogram_segment_probability", f"""{SEG_CTE},
v AS (SELECT risk_segment grp, churn_probability x FROM cseg),
e AS (SELECT grp, MIN(x) mn, MAX(x) mx, COUNT(*) n FROM v GROUP BY grp),
e2 AS (SELECT grp, n, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END hi FROM e),
c AS (SELECT v.grp, least(CAST(floor((x - lo) * (20.0::DOUBLE / (hi - lo))) AS INTEGER), 19) bin, COUNT(*) cnt
      FROM v JOIN e2 ON v.grp = e2.grp GROUP BY 1, 2),
grid AS (SELECT grp, n, lo, hi, CAST(b AS INTEGER) bin FROM e2, range(0, 20) r(b))
SELECT grid.grp "group", grid.bin, {R6('lo + grid.bin * ((hi - lo) / 20.0::DOUBLE)')} bin_start,
       {R6('lo + (grid.bin + 1) * ((hi - lo) / 20.0::DOUBLE)')} bin_end, CAST(COALESCE(cnt, 0) AS BIGINT) count,
       {R6('COALESCE(cnt, 0) / (n * ((hi - lo) / 20.0::DOUBLE))')} density
FROM grid LEFT JOIN c ON grid.grp = c.grp AND grid.bin = c.bin""")

# ---------------------------------------------------------------- scaler, weights, I/O round trips
register("standard_scaler", f"{SPLIT_CTE}\n" + " UNION ALL ".join(
    f"SELECT '{c}' feature, {R6(f'AVG(CAST({c} AS DOUBLE))')} mean, {R6(f'STDDEV_POP(CAST({c} AS DOUBLE))')} std FROM sp2 WHERE split = 'train'"
    for c in FEATURE_LIST))
register("class_weights", f"""{SPLIT_CTE},
tr AS (SELECT * FROM sp2 WHERE split = 'train'),
p AS (SELECT AVG(CAST(is_churned AS DOUBLE)) p, COUNT(*) n FROM tr)
SELECT is_churned "class", CAST(COUNT(*) AS BIGINT) count,
       CASE WHEN is_churned = 1 THEN (1 - ANY_VALUE(p.p)) / ANY_VALUE(p.p) ELSE 1.0 END ratio_weight,
       {R6('ANY_VALUE(p.n) / (2.0 * COUNT(*))')} balanced_weight
FROM tr, p GROUP BY is_churned""")
# ---------------------------------------------------------------- what fitted models must satisfy on the stored split
register("save_load_model", f"{SPLIT_CTE}\nSELECT customer_id, is_churned actual, TRUE same_probability FROM sp2 WHERE split = 'test'")
register("resolve_model", f"""{SPLIT_CTE}
SELECT 'boosted_trees' absent_model, 'random_forest' model, CAST(COUNT(*) AS BIGINT) AS rows, 0.0::DOUBLE max_difference FROM sp2 WHERE split = 'test'""")
register("model_decisions", f"""{SPLIT_CTE}
SELECT CAST(COUNT(*) AS BIGINT) segmented, CAST(SUM(is_churned) AS BIGINT) churners, CAST(COUNT(*) AS BIGINT) budgeted,
       CAST(SUM(is_churned) AS BIGINT) budgeted_churners, TRUE optimum_not_worse FROM sp2 WHERE split = 'test'""")
register("validation_log_check", "SELECT 200::BIGINT rounds, TRUE last_equals_scores")
register("logistic_probability_check", f"""{SPLIT_CTE}
SELECT CAST(COUNT(*) AS BIGINT) AS rows, TRUE within_tolerance, TRUE in_unit_interval FROM sp2 WHERE split = 'test'""")
register("logistic_optimality", f"SELECT {len(FEATURE_LIST) + 1}::BIGINT components, TRUE at_optimum")
register("read_or_default", f"""{CA_CTE}
SELECT 'stored' report, optimal_threshold, roi, net_benefit FROM ca
UNION ALL SELECT 'absent', 0.35::DOUBLE, 250.0::DOUBLE, 15000.0::DOUBLE""")
register("read_transactions_csv", "SELECT * FROM retail_raw")
register("verify_round_trip", "SELECT CAST(COUNT(*) AS BIGINT) rows_written, CAST(COUNT(*) AS BIGINT) rows_read, TRUE passed FROM tx")
register("stream_clean_transactions", "SELECT * FROM tx")

register("feature_summary", f"{FM_CTE}\n" + " UNION ALL ".join(
    f"SELECT '{c}' column_name, CAST(COUNT({c}) AS BIGINT) count, {R6(f'AVG(CAST({c} AS DOUBLE))')} mean, "
    f"{R6(f'STDDEV_SAMP(CAST({c} AS DOUBLE))')} std, MIN(CAST({c} AS DOUBLE)) min, "
    + ", ".join(f"{R6(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} p{int(round(p * 100))}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    + f", MAX(CAST({c} AS DOUBLE)) max FROM fmx" for c in FEATURE_LIST))
register("register_views", f"""
SELECT isodow(invoice_ts)::INTEGER AS weekday, COUNT(DISTINCT customer_id) AS buyers, COUNT(DISTINCT invoice) AS orders,
       CAST(SUM({LV}) AS DOUBLE) AS revenue, CAST(SUM(IF(hour(invoice_ts) BETWEEN 9 AND 16, {LV}, 0)) AS DOUBLE) AS daytime_revenue
FROM tx GROUP BY 1""")

# ---------------------------------------------------------------- purchase events view (short-horizon calendar)
from attrition.calendar import EVENTS_CALENDAR as ECAL  # noqa: E402

E_OBS, E_END, E_ELIG, E_DORMANT, E_ACQ = (D(ECAL.observation), D(ECAL.prediction_end), D(ECAL.eligibility_cutoff),
                                          D(ECAL.dormant_cutoff), D(ECAL.acquisition_cutoff))
EV_CTES = """
ev_raw AS (SELECT CAST(event_id AS VARCHAR) invoice, CAST(event_id % 50 AS VARCHAR) stock_code, CAST(NULL AS VARCHAR) description,
                  1.0::DOUBLE quantity, CAST(ts AS TIMESTAMP) invoice_ts, CAST(value AS DOUBLE) price, user_id customer_id,
                  'NATION_0' country
           FROM events WHERE event_type = 'purchase'),
evx AS (SELECT * FROM ev_raw
        WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C') AND quantity > 0 AND price > 0
          AND stock_code NOT IN ('POST','D','M','BANK CHARGES','PADS','DOT','CRUK','C2','AMAZONFEE'))"""


def with_events(body: str) -> str:
    return f"WITH {EV_CTES},\n{body.strip()}"


SQL["purchase_time_patterns_events"] = with_events(purchase_times("evx", E_OBS, E_DORMANT))
SQL["time_to_second_purchase_events"] = with_events(second_purchase("evx", E_ACQ, E_DORMANT))
SQL["churn_labels_events"] = with_events(f"""
lab AS (SELECT customer_id,
               CAST(1 - MAX(CAST(invoice_ts > {E_OBS} AND invoice_ts <= {E_END} AS INTEGER)) AS INTEGER) is_churned
        FROM evx GROUP BY customer_id HAVING MIN(invoice_ts) <= {E_ELIG})
SELECT * FROM lab""")
SQL["risk_segment"] = SQL["customer_segments"]
SQL["clipped_histogram"] = SQL["histogram_orders"]
register("quarantined_rows", """
SELECT 'malformed' AS reason, COUNT(*) AS rows FROM retail_raw WHERE price = 0""")
SQL["write_table"] = SQL["clean_transactions"]
register("stream_split", """
SELECT CASE WHEN price = 0 THEN 'malformed' WHEN customer_id IS NULL THEN 'has_customer' WHEN starts_with(invoice, 'C') THEN 'not_cancelled'
            WHEN quantity <= 0 THEN 'positive_quantity' WHEN stock_code IN ('POST','D','M','BANK CHARGES','PADS','DOT','CRUK','C2','AMAZONFEE') THEN 'not_service_code'
            ELSE 'clean' END AS reason, COUNT(*) AS rows
FROM retail_raw GROUP BY 1""")
register("schema_report", """
found AS (SELECT column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'bigint'
                 WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS current_type
          FROM (DESCRIBE SELECT * FROM retail_raw)),
wanted AS (SELECT unnest(['invoice', 'stock_code', 'description', 'quantity', 'invoice_ts', 'price', 'customer_id', 'country']) AS column_name,
                  unnest(['string', 'string', 'string', 'bigint', 'timestamp_ntz', 'double', 'bigint', 'string']) AS expected_type)
SELECT column_name, current_type, expected_type, IF(expected_type <> current_type, 'Yes', 'No') AS needs_conversion FROM found LEFT JOIN wanted USING (column_name)""")
