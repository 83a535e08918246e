"""DuckDB twins of the catalogue queries (same names, same output columns).

They are written the plain way (whole-person windows, direct joins) so that they
check the Spark formulations, which are built for skew and scale, against an
independent statement of the rule.
"""

from __future__ import annotations

# ------------------------------------------------------------ shared inputs

def hist_sql(src: str, person: str, order: str, ts: str, total: str, name: str = "hist") -> str:
    """History features W1-W9, W12, W13 of ``src`` in the plain whole-person window form.

    Rows with a null person get null features (they are not one person)."""
    return f"""
{name}0 AS (
  SELECT {person} AS person_id, {order} AS order_id,
         date_diff('second', TIMESTAMP '1970-01-01 00:00:00', {ts}) AS s,
         CAST(round({total} * 10000) AS BIGINT) AS cents
  FROM {src} WHERE {person} IS NOT NULL),
{name}1 AS (
  SELECT *,
    count(*) OVER wp AS n,
    lag(s) OVER w AS prev_s,
    min(s) OVER wp AS first_s,
    count(*) OVER (PARTITION BY person_id ORDER BY s
                   RANGE BETWEEN UNBOUNDED PRECEDING AND 7776001 PRECEDING) AS n_old,
    count(cents) OVER wp AS cnt, sum(CAST(cents AS HUGEINT)) OVER wp AS s1,
    sum(CAST(cents AS HUGEINT) * cents) OVER wp AS s2,
    count(*) OVER (PARTITION BY person_id) AS n_all
  FROM {name}0
  WINDOW w AS (PARTITION BY person_id ORDER BY s, order_id),
         wp AS (PARTITION BY person_id ORDER BY s, order_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}2 AS (
  SELECT *, CAST(floor((s - prev_s) / 86400) AS BIGINT) AS gap FROM {name}1),
{name}3 AS (
  SELECT *, sum(gap) OVER (PARTITION BY person_id ORDER BY s, order_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_before
  FROM {name}2),
{name} AS (
  SELECT order_id, person_id,
    CASE WHEN n > 0 THEN gap END AS time_since_last_purchase,
    CASE WHEN n = 1 THEN CAST(gap AS DOUBLE)
         WHEN n > 1 THEN CAST(gap_before AS DOUBLE) / n END AS time_between_purchases,
    CASE WHEN n > 0 THEN CAST(floor((s - first_s) / 86400) AS BIGINT) END AS time_since_first_purchase,
    CAST(n AS BIGINT) AS number_of_past_orders,
    CAST(n - n_old AS BIGINT) AS order_frequency_90_days,
    CASE WHEN cnt > 0 THEN CAST(s1 AS DOUBLE) / cnt / 10000.0 END AS average_order_value,
    CASE WHEN cnt > 0 THEN CAST(s1 AS DOUBLE) / 10000.0 END AS total_order_value,
    CASE WHEN cnt > 1 THEN sqrt(greatest(CAST(cnt * s2 - s1 * s1 AS DOUBLE), 0.0)
                                / (cnt * (cnt - 1))) / 10000.0 END AS std_order_value,
    CAST(n AS BIGINT) AS repeat_purchase_amount,
    CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS INTEGER) AS repeat_customer_initial,
    CAST(CASE WHEN n + 1 < n_all THEN 1 ELSE 0 END AS INTEGER) AS repeat_customer
  FROM {name}3)"""


HIST = """
hsrc AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders),""" + hist_sql(
    "hsrc", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")

ORACLE_SQL: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


ORACLE_SQL["score_history"] = _with(HIST) + """
SELECT order_id, person_id, time_since_last_purchase, time_between_purchases,
       time_since_first_purchase, number_of_past_orders, order_frequency_90_days,
       average_order_value, total_order_value, std_order_value, repeat_purchase_amount,
       repeat_customer
FROM hist"""

ORACLE_SQL["history_recency"] = _with(HIST) + """
SELECT order_id, person_id, time_since_last_purchase, time_between_purchases,
       time_since_first_purchase FROM hist"""

ORACLE_SQL["history_counts"] = _with(HIST) + """
SELECT order_id, person_id, number_of_past_orders, repeat_purchase_amount,
       order_frequency_90_days FROM hist"""

ORACLE_SQL["history_value"] = _with(HIST) + """
SELECT order_id, person_id, average_order_value, total_order_value, std_order_value FROM hist"""

ORACLE_SQL["repeat_flags"] = _with(HIST) + """
SELECT order_id, person_id, repeat_customer_initial, repeat_customer FROM hist"""

# ------------------------------------------------------------ items

from .standins import (TEST_BUNDLES, TEST_CATEGORIES, TEST_SKUS,  # noqa: E402
                       TEST_WHITELIST)


def _values(mapping: dict, k: str, v: str) -> str:
    rows = []
    for a, bs in mapping.items():
        for b in (bs if isinstance(bs, list) else [bs]):
            rows.append(f"('{a}', '{b}')")
    return f"(VALUES {', '.join(rows)}) AS t({k}, {v})"


def _inlist(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


LINES = """
lines AS (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_partkey AS part_key,
         p.p_brand AS sku, p.p_name AS name, l.l_quantity AS quantity,
         l.l_extendedprice AS subtotal
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

ENCODED = LINES + """,
lines_txt AS (
  SELECT *, 'id:' || CAST(line_no AS VARCHAR) || '|name:' || name
         || CASE WHEN part_key % 11 = 0 THEN '|sku:OLD' ELSE '' END
         || '|sku:' || sku
         || '|quantity:' || CASE WHEN part_key % 13 = 0 THEN 'x'
                                 ELSE CAST(CAST(quantity AS BIGINT) AS VARCHAR) END
         || '|subtotal:' || printf('%.2f', subtotal)
         || CASE WHEN line_no = 3 THEN '|junk' ELSE '' END AS txt
  FROM lines),
enc AS (
  SELECT order_id, string_agg(txt, ';' ORDER BY line_no, part_key, quantity, subtotal, txt)
         AS line_items
  FROM lines_txt GROUP BY order_id),
recs AS (
  SELECT order_id, unnest(string_split(line_items, ';')) AS rec,
         unnest(range(1, len(string_split(line_items, ';')) + 1)) AS pos
  FROM enc),
fields AS (
  SELECT order_id, pos,
    substr(list_filter(string_split(rec, '|'), lambda t: starts_with(t, 'sku:'))[-1], 5) AS sku,
    substr(list_filter(string_split(rec, '|'), lambda t: starts_with(t, 'quantity:'))[-1], 10)
      AS quantity_txt,
    substr(list_filter(string_split(rec, '|'), lambda t: starts_with(t, 'subtotal:'))[-1], 10)
      AS subtotal_txt
  FROM recs),
flat AS (
  SELECT order_id, pos, coalesce(sku, 'nan') AS sku,
         coalesce(try_cast(quantity_txt AS DOUBLE), 0.0) AS quantity,
         coalesce(try_cast(subtotal_txt AS DOUBLE), 0.0) AS subtotal
  FROM fields WHERE coalesce(sku, 'nan') <> '')"""

ORACLE_SQL["items_parse"] = _with(ENCODED) + """
SELECT order_id, pos, sku, coalesce(try_cast(quantity_txt AS DOUBLE), 0.0) AS quantity,
       coalesce(try_cast(subtotal_txt AS DOUBLE), 0.0) AS subtotal
FROM fields"""

ORACLE_SQL["items_flatten"] = _with(ENCODED) + """
SELECT order_id, pos, sku, quantity, subtotal FROM flat"""

ORACLE_SQL["items_wide"] = _with(ENCODED) + """, f AS (
  SELECT order_id, pos, unnest(string_split(rec, '|')) AS t, unnest(range(len(string_split(rec, '|')))) AS i FROM recs)
SELECT order_id, pos AS slot, split_part(t, ':', 1) AS key, arg_max(substr(t, instr(t, ':') + 1), i) AS value
FROM f WHERE instr(t, ':') > 0 GROUP BY ALL"""


def _pivot_sql(value: str, suffix: str, rnd: bool) -> str:
    cols = []
    for s in TEST_SKUS:
        agg = f"sum(CASE WHEN f.sku = '{s}' THEN f.{value} ELSE 0 END)"
        if rnd:
            agg = f"round({agg}, 2)"
        cols.append(f"coalesce({agg}, 0) AS \"{s}{suffix}\"")
    return _with(ENCODED) + f"""
SELECT o.o_orderkey AS order_id, {', '.join(cols)}
FROM orders o LEFT JOIN flat f ON f.order_id = o.o_orderkey
GROUP BY o.o_orderkey"""


ORACLE_SQL["sku_count_pivot"] = _pivot_sql("quantity", "_count", False)
ORACLE_SQL["sku_subtotal_pivot"] = _pivot_sql("subtotal", "_subtotal", True)

ORACLE_SQL["bundle_expand"] = _with(ENCODED) + f""",
b AS (SELECT * FROM {_values(TEST_BUNDLES, 'bundle', 'component')}),
x AS (SELECT f.order_id, coalesce(b.component, f.sku) AS sku, f.quantity
      FROM flat f LEFT JOIN b ON f.sku = b.bundle)
SELECT order_id, sku, sum(quantity) AS quantity FROM x
WHERE sku IN {_inlist(TEST_WHITELIST)}
GROUP BY order_id, sku"""

ORACLE_SQL["bundle_audit"] = _with(ENCODED) + f""",
b AS (SELECT * FROM {_values(TEST_BUNDLES, 'bundle', 'component')})
SELECT b.bundle, b.component, sum(f.quantity) AS quantity
FROM flat f JOIN b ON f.sku = b.bundle GROUP BY b.bundle, b.component"""

ORACLE_SQL["category_presence"] = _with(ENCODED) + f""",
c AS (SELECT * FROM {_values(TEST_CATEGORIES, 'sku', 'category')})
SELECT f.order_id, c.category, CAST(sum(f.quantity) > 0 AS INTEGER) AS present
FROM flat f JOIN c ON f.sku = c.sku GROUP BY f.order_id, c.category"""

# --------------------------------------------------------- product history

PROD = LINES + """,
po AS (
  SELECT o_custkey AS person_id, o_orderkey AS order_id,
         date_diff('second', TIMESTAMP '1970-01-01 00:00:00', o_orderdate) AS s
  FROM orders),
os AS (SELECT order_id, sku FROM lines GROUP BY order_id, sku HAVING sum(quantity) > 0),
ev AS (SELECT po.person_id, po.order_id, po.s, os.sku FROM po JOIN os USING (order_id)),
prev AS (
  SELECT o.order_id, o.person_id, e.sku, count(*) AS cnt
  FROM po o JOIN ev e ON e.person_id = o.person_id
   AND (e.s < o.s OR (e.s = o.s AND e.order_id < o.order_id))
  GROUP BY o.order_id, o.person_id, e.sku)"""

ORACLE_SQL["history_products_distinct"] = _with(PROD) + """
SELECT o.order_id, o.person_id, CAST(count(p.sku) AS BIGINT) AS distinct_product_amount
FROM po o LEFT JOIN prev p ON p.order_id = o.order_id
GROUP BY o.order_id, o.person_id"""

ORACLE_SQL["history_products_mode"] = _with(PROD) + """,
ranked AS (
  SELECT order_id, sku, row_number() OVER (PARTITION BY order_id ORDER BY cnt DESC, sku) AS rn
  FROM prev)
SELECT o.order_id, o.person_id, r.sku AS most_frequent_product
FROM po o LEFT JOIN ranked r ON r.order_id = o.order_id AND r.rn = 1"""

ORACLE_SQL["next_sku_labels"] = _with(PROD) + """,
nx AS (
  SELECT order_id, person_id,
         lead(order_id) OVER (PARTITION BY person_id ORDER BY s, order_id) AS next_order_id
  FROM po),
q AS (SELECT order_id, sku, sum(quantity) AS next_count FROM lines GROUP BY order_id, sku)
SELECT nx.order_id, nx.person_id, q.sku, q.next_count
FROM nx JOIN q ON q.order_id = nx.next_order_id"""

# ------------------------------------------------------- contact text rules

from .. import lookups as L  # noqa: E402

CUST = """
cb AS (
  SELECT c.c_custkey AS k, c.c_nationkey AS n, c.c_mktsegment AS seg, p.p_name AS pn,
         lpad(CAST(c.c_nationkey * 1000 + c.c_custkey % 3 AS VARCHAR), 5, '0') AS zp
  FROM customer c JOIN part p ON c.c_custkey * 7 % (SELECT count(*) FROM part) = p.p_partkey),
cust AS (
  SELECT k AS c_custkey,
    CASE WHEN k % 41 = 7 THEN NULL WHEN k % 3 = 0 THEN upper(pn)
         WHEN k % 3 = 1 THEN ' ' || pn || ' ' ELSE pn END AS billing_first_name,
    'Last' || CAST(k % 500 AS VARCHAR) AS billing_last_name,
    CASE WHEN k % 53 = 3 THEN NULL
         WHEN k % 4 = 0 THEN zp || '-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0')
         WHEN k % 4 = 1 THEN ' ' || zp || '-12'
         WHEN k % 4 = 2 THEN zp ELSE zp || '-123456' END AS billing_postcode,
    CASE k % 5
      WHEN 0 THEN lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '-555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0')
      WHEN 1 THEN '1 (' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ') 555 ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0')
      WHEN 2 THEN 'abc' || CAST(k AS VARCHAR)
      WHEN 3 THEN NULL
      ELSE '+44 20 ' || CAST(k AS VARCHAR) END AS billing_phone,
    CASE k % 6
      WHEN 0 THEN 'u' || CAST(k AS VARCHAR) || '@gmail.com'
      WHEN 1 THEN 'u' || CAST(k AS VARCHAR) || '@school.edu'
      WHEN 2 THEN 'u' || CAST(k AS VARCHAR) || '@' || lower(seg) || '.com'
      WHEN 3 THEN 'u' || CAST(k AS VARCHAR) || '@mail.de'
      WHEN 4 THEN NULL
      ELSE 'u' || CAST(k AS VARCHAR) || '.example.org' END AS billing_email,
    CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN 'Retired' WHEN 3 THEN 'Guest'
      WHEN 4 THEN 'Self Employed' WHEN 5 THEN 'Title (optional)' WHEN 6 THEN 'Unknown'
      ELSE seg || ' Inc' END AS billing_company,
    CASE (k + 3) % 8 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN 'Retired' WHEN 3 THEN 'Guest'
      WHEN 4 THEN 'Self Employed' WHEN 5 THEN 'Title (optional)' WHEN 6 THEN 'Unknown'
      ELSE seg || ' Inc' END AS shipping_company,
    CASE n % 6 WHEN 0 THEN 'Oregon' WHEN 1 THEN ' new york ' WHEN 2 THEN 'CA' WHEN 3 THEN NULL
      WHEN 4 THEN 'District of Columbia' ELSE 'Ontario' END AS billing_state,
    'City' || CAST(n % 10 AS VARCHAR) AS billing_city,
    CASE WHEN k % 9 = 0 THEN NULL ELSE 'City' || CAST((n + k) % 10 AS VARCHAR) END AS shipping_city,
    CASE k % 4 WHEN 0 THEN 'id:' || CAST(k AS VARCHAR) || '|code:c' WHEN 1 THEN 'id:|code:x'
      WHEN 2 THEN NULL ELSE 'code:y' END AS coupon_items
  FROM cb)"""

CENSUS = """
census AS (
  SELECT lpad(CAST(n_nationkey * 1000 AS VARCHAR), 5, '0') AS zip,
    CASE n_nationkey % 5 WHEN 0 THEN '250,000+' WHEN 1 THEN '2,500-' WHEN 2 THEN '-'
      WHEN 3 THEN CAST(n_nationkey * 1234 + 40000 AS VARCHAR) ELSE '(X)' END AS median_household_income,
    CASE n_nationkey % 5 WHEN 0 THEN '***' WHEN 1 THEN '**' WHEN 2 THEN 'N'
      WHEN 3 THEN CAST(n_nationkey + 1000 AS VARCHAR) ELSE '1,234' END AS moe_median_household_income,
    CASE n_nationkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN '80,500'
      ELSE CAST(n_nationkey * 321 + 50000 AS VARCHAR) END AS mean_household_income,
    CASE n_nationkey % 4 WHEN 0 THEN '***' WHEN 1 THEN '-'
      ELSE CAST(n_nationkey + 2000 AS VARCHAR) END AS moe_mean_household_income
  FROM nation)"""

NAMES = """
names AS (
  SELECT CASE p_partkey % 3 WHEN 0 THEN ' ' || upper(p_name) WHEN 1 THEN p_name
              ELSE p_name || ' ' END AS Name,
         CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'F' END AS Gender,
         CAST(p_size AS DOUBLE) / 50.0 AS Probability
  FROM part),
nb AS (
  SELECT lower(regexp_replace(Name, '^\\s+|\\s+$', '', 'g')) AS name_key, Gender AS gender,
         Probability AS probability_of_gender,
         row_number() OVER (PARTITION BY lower(regexp_replace(Name, '^\\s+|\\s+$', '', 'g'))
                            ORDER BY Probability DESC, Gender) AS rn
  FROM names),
names_best AS (SELECT name_key, gender, probability_of_gender FROM nb WHERE rn = 1)"""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _phone(c: str) -> str:
    d = f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"
    return (f"CASE WHEN length({d}) = 10 THEN '+1 (' || substr({d}, 1, 3) || ') ' || substr({d}, 4, 3)"
            f" || '-' || substr({d}, 7, 4)"
            f" WHEN length({d}) = 11 AND {d} LIKE '1%' THEN '+1 (' || substr({d}, 2, 3) || ') '"
            f" || substr({d}, 5, 3) || '-' || substr({d}, 8, 4) ELSE {d} END")


def _area(p: str) -> str:
    code = f"regexp_extract({p}, '\\((\\d{{3}})\\)', 1)"
    return f"CASE WHEN {p} IS NULL OR {_strip(p)} = '' OR {code} = '' THEN 'UNKNOWN' ELSE {code} END"


def _company(c: str) -> str:
    unknown = _inlist(L.COMPANY_UNKNOWN_WORDS)
    return (f"CASE WHEN {c} IS NULL OR lower({_strip(c)}) IN {unknown} THEN 'UNKNOWN'"
            f" WHEN contains(lower({c}), 'retired') THEN 'RETIREMENT'"
            f" WHEN contains(lower({c}), 'guest') OR contains(lower({c}), 'self employed') THEN 'PERSONAL'"
            f" ELSE 'BUSINESS' END")


def _domain(e: str) -> str:
    return f"CASE WHEN {e} IS NULL OR strpos({e}, '@') = 0 THEN 'UNKNOWN' ELSE split_part({e}, '@', 2) END"


def _email_cat(d: str) -> str:
    return (f"CASE WHEN {d} = 'UNKNOWN' THEN 'UNKNOWN' WHEN suffix({d}, '.edu') THEN 'EDUCATION'"
            f" WHEN {d} IN {_inlist(L.PERSONAL_EMAIL_HOSTS)} THEN 'PERSONAL'"
            f" WHEN suffix({d}, '.com') OR suffix({d}, '.net') OR suffix({d}, '.org') THEN 'CORPORATE'"
            f" ELSE 'OTHER' END")


def _zip_main(c: str) -> str:
    return f"split_part({_strip(c)}, '-', 1)"


def _income(c: str) -> str:
    t = f"regexp_replace({c}, '[,+\\-N]', '', 'g')"
    return f"CASE WHEN {t} <> '' THEN try_cast({t} AS DOUBLE) END"


def _margin(c: str) -> str:
    return (f"CASE WHEN {c} IN {_inlist(L.MARGIN_NULL_SYMBOLS)} THEN NULL"
            f" ELSE try_cast(replace({c}, ',', '') AS DOUBLE) END")


STATES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.STATE_CODES.items()) + ") AS st(sname, scode)"

ORACLE_SQL["phone_area_code"] = _with(CUST) + f""",
ph AS (SELECT c_custkey, {_phone('billing_phone')} AS billing_phone FROM cust)
SELECT c_custkey, billing_phone, {_area('billing_phone')} AS phone_area_code,
       CASE WHEN {_area('billing_phone')} = 'UNKNOWN' THEN '' ELSE {_area('billing_phone')} END
         AS phone_area_code_clean
FROM ph"""

ORACLE_SQL["postcode_state"] = _with(CUST) + f""",
x AS (SELECT *, lower({_strip('billing_state')}) AS skey, {_strip('billing_postcode')} AS pc FROM cust)
SELECT c_custkey, {_zip_main('billing_postcode')} AS billing_zip_main,
       CASE WHEN strpos(pc, '-') > 0 THEN substr(substr(pc, strpos(pc, '-') + 1), 1, 4) END
         AS billing_zip_extra,
       substr(billing_postcode, 1, 5) AS zip,
       upper(coalesce(st.scode, skey)) AS billing_state
FROM x LEFT JOIN {STATES} ON st.sname = x.skey"""

ORACLE_SQL["email_category"] = _with(CUST) + f""",
d AS (SELECT c_custkey, {_domain('billing_email')} AS email_domain FROM cust)
SELECT c_custkey, email_domain, {_email_cat('email_domain')} AS email_category FROM d"""

ORACLE_SQL["company_category"] = _with(CUST) + f"""
SELECT c_custkey,
  CAST(billing_company IS NOT NULL AND {_strip('billing_company')} <> '' AS INTEGER) AS has_billing_company,
  {_company('billing_company')} AS billing_company_category,
  CAST(shipping_company IS NOT NULL AND {_strip('shipping_company')} <> '' AS INTEGER)
    AS has_shipping_company,
  {_company('shipping_company')} AS shipping_company_category
FROM cust"""

ORACLE_SQL["person_keys"] = _with(CUST) + f"""
SELECT c_custkey,
  lower(billing_first_name) || '_' || lower(billing_last_name) || '_'
    || coalesce({_zip_main('billing_postcode')}, 'nan') AS customer_identifier,
  lower({_strip('billing_first_name')}) || ' ' || lower({_strip('billing_last_name')}) || ' '
    || lower(coalesce({_zip_main('billing_postcode')}, '')) AS person_id
FROM cust"""

ORACLE_SQL["census_enrich"] = _with(CUST, CENSUS) + """
SELECT c.c_custkey, substr(c.billing_postcode, 1, 5) AS zip, s.median_household_income,
       s.moe_median_household_income, s.mean_household_income, s.moe_mean_household_income
FROM cust c LEFT JOIN census s ON s.zip = substr(c.billing_postcode, 1, 5)"""

ORACLE_SQL["income_clean"] = _with(CENSUS) + f"""
SELECT zip, {_income('median_household_income')} AS median_household_income,
       {_margin('moe_median_household_income')} AS moe_median_household_income,
       {_income('mean_household_income')} AS mean_household_income,
       {_margin('moe_mean_household_income')} AS moe_mean_household_income,
       CAST(coalesce(moe_median_household_income = '***', false)
            OR coalesce(moe_mean_household_income = '***', false) AS INTEGER) AS is_income_censored
FROM census"""

ORACLE_SQL["gender_lookup_best"] = _with(NAMES) + """
SELECT name_key, gender, probability_of_gender FROM names_best"""

ORACLE_SQL["gender_enrich"] = _with(CUST, NAMES) + """
SELECT c.c_custkey, coalesce(b.gender, 'Unknown') AS gender, b.probability_of_gender,
       CASE coalesce(b.gender, 'Unknown') WHEN 'M' THEN 1 WHEN 'F' THEN 0 END AS gender_binary
FROM cust c LEFT JOIN names_best b ON b.name_key = lower(c.billing_first_name)"""

ORACLE_SQL["flags"] = _with(CUST) + f""",
cp AS (SELECT c_custkey, billing_company,
         substr(list_filter(string_split(string_split(coupon_items, ';')[1], '|'),
                            lambda t: starts_with(t, 'id:'))[-1], 4) AS coupon_1_id
       FROM cust)
SELECT c_custkey, coupon_1_id,
       CASE WHEN coupon_1_id IS NOT NULL AND coupon_1_id <> '' THEN 1 ELSE 0 END AS used_coupon,
       CAST(billing_company IS NOT NULL AND {_strip('billing_company')} <> '' AS INTEGER)
         AS has_billing_company
FROM cp"""

ORACLE_SQL["order_time_parts"] = """
SELECT event_id, day(ts) AS order_day, month(ts) AS order_month, year(ts) AS order_year,
       strftime(ts, '%H:%M:%S') AS order_time, hour(ts) AS order_hour, minute(ts) AS order_minute,
       date_trunc('second', ts) AS order_datetime
FROM events"""

ORACLE_SQL["cyclical"] = "SELECT event_id, " + ", ".join(
    f"round(sin(2 * pi() * CAST({f}(ts) AS DOUBLE) / {float(p)}), 9) AS order_{n}_sin, "
    f"round(cos(2 * pi() * CAST({f}(ts) AS DOUBLE) / {float(p)}), 9) AS order_{n}_cos"
    for n, f, p in [("day", "day", 31), ("month", "month", 12), ("hour", "hour", 24),
                    ("minute", "minute", 60)]) + " FROM events"

CUST_ORDERS = CUST + """,
co AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, c.*
  FROM orders o JOIN cust c ON c.c_custkey = o.o_custkey)"""

ORACLE_SQL["purchase_counts"] = _with(CUST_ORDERS) + f""",
ci AS (
  SELECT order_id, lower(billing_first_name) || '_' || lower(billing_last_name) || '_'
           || coalesce({_zip_main('billing_postcode')}, 'nan') AS customer_identifier
  FROM co),
cnt AS (SELECT customer_identifier, count(*) AS purchase_count FROM ci
        WHERE customer_identifier IS NOT NULL GROUP BY customer_identifier)
SELECT ci.order_id, ci.customer_identifier, CAST(cnt.purchase_count AS BIGINT) AS purchase_count,
       CAST(CASE WHEN cnt.purchase_count > 1 THEN 1 ELSE 0 END AS INTEGER) AS repeat_purchase
FROM ci LEFT JOIN cnt USING (customer_identifier)"""

ORACLE_SQL["multi_order_total"] = """
WITH per AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)
SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS orders_of_repeat_keys,
       CAST(count(CASE WHEN n > 1 THEN 1 END) AS BIGINT) AS repeat_keys
FROM per"""

ORACLE_SQL["city_frequency"] = _with(CUST_ORDERS) + """,
bc AS (SELECT billing_city, count(*) AS f FROM co WHERE billing_city IS NOT NULL GROUP BY 1),
sc AS (SELECT shipping_city, count(*) AS f FROM co WHERE shipping_city IS NOT NULL GROUP BY 1)
SELECT co.order_id, co.billing_city, co.shipping_city,
       CAST(bc.f AS BIGINT) AS billing_city_frequency, CAST(sc.f AS BIGINT) AS shipping_city_frequency
FROM co LEFT JOIN bc USING (billing_city) LEFT JOIN sc USING (shipping_city)"""

# ------------------------------------------------------------------ metrics

SCORED = """
sc AS (SELECT l_linestatus AS target, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
              l_discount * 5 + l_tax AS score FROM lineitem)"""


def _cum(by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return SCORED + f""",
cnt AS (SELECT {sel}score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY {sel}score),
cum AS (
  SELECT {sel}score, pos, neg,
    coalesce(sum(pos) OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS pos_above,
    coalesce(sum(neg) OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS neg_above,
    coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS neg_below,
    sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS N
  FROM cnt),
pts AS (
  SELECT {sel}score AS threshold, pos_above + pos AS tp, neg_above + neg AS fp, P, N FROM cum),
pr AS (
  SELECT {sel}threshold,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
    CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) ELSE 1.0 END AS recall,
    CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp
  FROM pts)"""


ORACLE_SQL["pr_curve"] = _with(_cum()) + """
SELECT threshold, precision, recall, tp, fp FROM pr
UNION ALL SELECT NULL, 1.0, 0.0, NULL, NULL"""

ORACLE_SQL["roc_curve"] = _with(_cum()) + """
SELECT threshold, CAST(fp AS DOUBLE) / CAST(N AS DOUBLE) AS fpr,
       CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) AS tpr FROM pts
UNION ALL SELECT NULL, 0.0, 0.0"""


def _auc_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return _with(_cum(by)) + f"""
SELECT {sel}CASE WHEN max(P) * max(N) > 0 THEN
         CAST(sum(pos * (2 * neg_below + neg)) AS DOUBLE) / CAST(2 * max(P) * max(N) AS DOUBLE) END AS auc,
       CAST(max(P) AS BIGINT) AS positives, CAST(max(N) AS BIGINT) AS negatives
FROM cum {grp}"""


ORACLE_SQL["auc"] = _auc_sql()
ORACLE_SQL["auc_per_target"] = _auc_sql("target")
ORACLE_SQL["auc_weighted"] = "WITH per AS (" + _auc_sql("target") + """)
SELECT round(sum(auc * positives) / sum(positives), 12) AS auc_weighted FROM per WHERE auc IS NOT NULL"""

CONF = SCORED + """,
conf AS (SELECT CAST(y AS INTEGER) AS y, CAST(score >= 0.3 AS INTEGER) AS pred, count(*) AS n
         FROM sc GROUP BY 1, 2),
w AS (SELECT coalesce(sum(CASE WHEN y = 0 AND pred = 0 THEN n END), 0) AS c00,
             coalesce(sum(CASE WHEN y = 0 AND pred = 1 THEN n END), 0) AS c01,
             coalesce(sum(CASE WHEN y = 1 AND pred = 0 THEN n END), 0) AS c10,
             coalesce(sum(CASE WHEN y = 1 AND pred = 1 THEN n END), 0) AS c11 FROM conf),
st AS (SELECT 0 AS label, c00 AS tp, c10 AS fp, c01 AS fn, c00 + c01 AS support FROM w
       UNION ALL SELECT 1, c11, c01, c10, c11 + c10 FROM w),
prf AS (
  SELECT label, support, tp,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE)
         ELSE 0.0 END AS f1
  FROM st)"""

ORACLE_SQL["confusion"] = _with(CONF) + " SELECT y, pred, CAST(n AS BIGINT) AS n FROM conf"

ORACLE_SQL["class_report"] = _with(CONF) + """
SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM prf
UNION ALL SELECT 'macro avg', sum(precision) / 2, sum(recall) / 2, sum(f1) / 2,
                 CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                 sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
                 CAST(sum(support) AS BIGINT) FROM prf"""

ORACLE_SQL["pooled_metrics"] = _with(CONF) + """
SELECT CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy,
       sum(precision) / 2 AS precision_macro, sum(recall) / 2 AS recall_macro,
       sum(f1) / 2 AS f1_macro FROM prf"""

ORACLE_SQL["threshold_f1"] = _with(_cum()) + """,
f AS (SELECT *, (2.0 * precision * recall) / (precision + recall + CAST('1e-9' AS DOUBLE)) AS f1 FROM pr),
r AS (SELECT *, row_number() OVER (ORDER BY f1 DESC, threshold) AS rn FROM f)
SELECT threshold, precision, recall, f1 FROM r WHERE rn = 1"""

ORACLE_SQL["threshold_f1_recall"] = _with(_cum("target")) + """,
f AS (SELECT *, (2.0 * precision * recall) / (precision + recall + CAST('1e-10' AS DOUBLE)) AS f1 FROM pr),
r AS (SELECT *, row_number() OVER (PARTITION BY target
                                   ORDER BY f1 + CAST('0.01' AS DOUBLE) * recall DESC, threshold) AS rn
      FROM f)
SELECT target, threshold, precision, recall, f1 FROM r WHERE rn = 1"""

ORACLE_SQL["threshold_min_precision"] = _with(_cum()) + """
SELECT coalesce(min(CASE WHEN precision >= 0.35 THEN threshold END), 1.0) AS threshold FROM pr"""

ORACLE_SQL["threshold_precision_recall"] = _with(_cum()) + """
SELECT coalesce(min(CASE WHEN precision >= 0.3 AND recall > precision THEN threshold END), 0.5)
  AS threshold FROM pr"""

_STEP = repr((0.9 - 0.01) / 99)
ORACLE_SQL["threshold_sweep"] = _with(SCORED) + f""",
th AS (SELECT CASE WHEN i = 99 THEN CAST('0.9' AS DOUBLE)
                   ELSE CAST(i AS DOUBLE) * CAST('{_STEP}' AS DOUBLE) + CAST('0.01' AS DOUBLE) END AS threshold
       FROM range(100) t(i)),
tot AS (SELECT sum(y) AS P, sum(1 - y) AS N FROM sc),
c AS (SELECT th.threshold, count(sc.y) FILTER (WHERE sc.y = 1) AS tp,
             count(sc.y) FILTER (WHERE sc.y = 0) AS fp
      FROM th LEFT JOIN sc ON sc.score > th.threshold GROUP BY th.threshold),
m AS (
  SELECT c.threshold, c.tp, c.fp, tot.P - c.tp AS fn, tot.N - c.fp AS tn
  FROM c, tot),
f AS (
  SELECT threshold,
    (CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END
     + CASE WHEN 2 * tn + fn + fp > 0 THEN CAST(2 * tn AS DOUBLE) / CAST(2 * tn + fn + fp AS DOUBLE) ELSE 0.0 END)
    / 2 AS f1_macro
  FROM m),
r AS (SELECT *, row_number() OVER (ORDER BY f1_macro DESC, threshold) AS rn FROM f)
SELECT threshold, f1_macro FROM r WHERE rn = 1"""

# ------------------------------------------------------------ split, weights


def _bucket(p: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5('42|' || CAST({p} AS VARCHAR)), 1, 8)) AS BIGINT) % 10000 AS INTEGER)"


def _side(p: str) -> str:
    return f"CASE WHEN {_bucket(p)} < 2000 THEN 'test' ELSE 'train' END"


LAB = HIST + f""",
lab AS (SELECT person_id, order_id, repeat_customer, {_side('person_id')} AS split FROM hist)"""

ORACLE_SQL["person_split"] = _with(HIST) + f"""
SELECT person_id, CAST(max(CASE WHEN repeat_customer > 0 THEN 1 ELSE 0 END) AS INTEGER) AS has_positive,
       {_bucket('person_id')} AS bucket, {_side('person_id')} AS split
FROM hist WHERE person_id IS NOT NULL GROUP BY person_id"""

ORACLE_SQL["stratified_split"] = _with(HIST) + f"""
, per AS (SELECT person_id, CAST(max(CASE WHEN repeat_customer > 0 THEN 1 ELSE 0 END) AS INTEGER) AS has_positive
          FROM hist WHERE person_id IS NOT NULL GROUP BY person_id),
s AS (SELECT has_positive, count(*) AS n, (SELECT count(*) FROM per) AS total FROM per GROUP BY has_positive),
q AS (SELECT *, CAST(ceil(total / 5.0) AS BIGINT) AS quota FROM s),
f AS (SELECT *, quota * n // total AS base, row_number() OVER (ORDER BY quota * n % total DESC, has_positive) AS k FROM q),
t AS (SELECT has_positive, base + CASE WHEN k <= quota - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS take FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY has_positive
        ORDER BY {_bucket('person_id')}, md5('42|' || person_id::VARCHAR), person_id) AS rn FROM per)
SELECT person_id, has_positive, CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS split FROM r JOIN t USING (has_positive)"""

ORACLE_SQL["split_leak_check"] = _with(LAB) + """,
per AS (SELECT person_id, count(DISTINCT split) AS sides FROM lab GROUP BY person_id)
SELECT CAST(count(CASE WHEN sides > 1 THEN 1 END) AS BIGINT) AS overlap FROM per"""

ORACLE_SQL["split_counts"] = _with(LAB) + """,
per AS (SELECT split, person_id, max(CASE WHEN repeat_customer = 1 THEN 1 ELSE 0 END) AS pos
        FROM lab GROUP BY split, person_id)
SELECT split, CAST(count(*) AS BIGINT) AS persons, CAST(sum(pos) AS BIGINT) AS persons_with_positive
FROM per GROUP BY split"""

ORACLE_SQL["class_weights"] = _with(LAB) + """,
c AS (SELECT CAST(repeat_customer AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n
      FROM lab WHERE split = 'train' GROUP BY 1)
SELECT label, n,
       CAST(sum(n) OVER () AS DOUBLE) / (2.0 * n) AS balanced_weight,
       CAST(sum(CASE WHEN label = 0 THEN n END) OVER () AS DOUBLE)
         / CAST(sum(CASE WHEN label = 1 THEN n END) OVER () AS DOUBLE) AS scale_pos_weight
FROM c"""

SKU_LAB = _with(PROD) + """,
nx AS (
  SELECT order_id, person_id,
         lead(order_id) OVER (PARTITION BY person_id ORDER BY s, order_id) AS next_order_id
  FROM po),
q AS (SELECT order_id, sku, sum(quantity) AS next_count FROM lines GROUP BY order_id, sku),
sl AS (SELECT nx.order_id, nx.person_id, q.sku, CASE WHEN q.next_count > 0 THEN 1 ELSE 0 END AS y
       FROM nx JOIN q ON q.order_id = nx.next_order_id)"""

ORACLE_SQL["labelled_rows"] = SKU_LAB + """
SELECT order_id, CAST(count(*) AS BIGINT) AS positive_labels FROM sl WHERE y > 0 GROUP BY order_id"""

ORACLE_SQL["label_weights"] = SKU_LAB + f""",
per AS (SELECT sku, CAST(sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positives
        FROM sl WHERE {_side('person_id')} = 'train' GROUP BY sku)
SELECT sku, positives,
       CAST(sum(positives) OVER () AS DOUBLE) / CAST(count(*) OVER () * greatest(positives, 1) AS DOUBLE)
         AS weight
FROM per"""

# ------------------------------------------------------------ cleaning DAG

RAW = CUST + "," + ENCODED + """,
raw AS (
  SELECT o.o_orderkey AS order_id, o.o_totalprice AS order_total,
    strftime(o.o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(o.o_orderkey % 24 AS VARCHAR), 2, '0')
      || ':' || lpad(CAST(o.o_orderkey % 60 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(o.o_orderkey % 7 AS VARCHAR), 2, '0') AS date,
    CASE o.o_orderkey % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'paypal' WHEN 2 THEN 'card' ELSE 'bank' END
      AS payment_method,
    c.*, e.line_items
  FROM orders o JOIN cust c ON c.c_custkey = o.o_custkey
  LEFT JOIN enc e ON e.order_id = o.o_orderkey)"""

CLEANED = RAW + "," + CENSUS + "," + NAMES + f""",
cl0 AS (
  SELECT r.*, strptime(r.date, '%Y-%m-%d %H:%M:%S') AS ts,
    {_zip_main('r.billing_postcode')} AS zm,
    {_phone('r.billing_phone')} AS phone_std,
    {_domain('r.billing_email')} AS email_domain,
    lower({_strip('r.billing_state')}) AS skey,
    s.median_household_income AS med_txt, s.moe_median_household_income AS moe_med_txt,
    s.moe_mean_household_income AS moe_mean_txt,
    coalesce(b.gender, 'Unknown') AS gender
  FROM raw r
  LEFT JOIN census s ON s.zip = substr(r.billing_postcode, 1, 5)
  LEFT JOIN names_best b ON b.name_key = lower(r.billing_first_name)),
cl AS (
  SELECT cl0.*,
    lower({_strip('billing_first_name')}) || ' ' || lower({_strip('billing_last_name')}) || ' '
      || lower(coalesce(zm, '')) AS person_id,
    upper(coalesce(st.scode, skey)) AS billing_state_code,
    {_email_cat('email_domain')} AS email_category,
    {_company('billing_company')} AS billing_company_category
  FROM cl0 LEFT JOIN {STATES} ON st.sname = cl0.skey)"""

_B = _values(TEST_BUNDLES, 'bundle', 'component')

CLEAN_SQL = _with(CLEANED) + "," + hist_sql("cl", "person_id", "order_id", "ts", "order_total") + f""",
items AS (SELECT order_id, sku, quantity FROM flat),
cond AS (
  SELECT i.order_id, coalesce(b.component, i.sku) AS sku, i.quantity
  FROM items i LEFT JOIN (SELECT * FROM {_B}) b ON b.bundle = i.sku),
cnt AS (
  SELECT order_id,
    sum(CASE WHEN sku = 'Brand#1' THEN quantity ELSE 0 END) AS b1,
    sum(CASE WHEN sku = 'Brand#7' THEN quantity ELSE 0 END) AS b7,
    sum(CASE WHEN sku = 'nan' THEN quantity ELSE 0 END) AS bnan
  FROM cond WHERE sku IN {_inlist(TEST_WHITELIST)} GROUP BY order_id),
os AS (SELECT order_id, sku FROM items GROUP BY order_id, sku HAVING sum(quantity) > 0),
pe AS (SELECT h0.person_id, h0.order_id, h0.s FROM hist0 h0),
ev AS (SELECT pe.*, os.sku FROM pe JOIN os USING (order_id)),
w10 AS (
  SELECT o.order_id, count(DISTINCT e.sku) AS dpa
  FROM pe o LEFT JOIN ev e ON e.person_id = o.person_id
   AND (e.s < o.s OR (e.s = o.s AND e.order_id < o.order_id))
  GROUP BY o.order_id),
full_t AS (
  SELECT cl.order_id, cl.person_id, year(cl.ts) AS order_year, hour(cl.ts) AS order_hour,
    {_income('cl.med_txt')} AS median_household_income,
    {_margin('cl.moe_med_txt')} AS moe_median_household_income,
    CAST(coalesce(cl.moe_med_txt = '***', false) OR coalesce(cl.moe_mean_txt = '***', false) AS INTEGER)
      AS is_income_censored,
    CAST(cl.billing_company IS NOT NULL AND {_strip('cl.billing_company')} <> '' AS INTEGER)
      AS has_billing_company,
    CASE cl.gender WHEN 'M' THEN 1 WHEN 'F' THEN 0 END AS gender_binary,
    CASE WHEN substr(list_filter(string_split(string_split(cl.coupon_items, ';')[1], '|'),
                                 lambda t: starts_with(t, 'id:'))[-1], 4) <> '' THEN 1 ELSE 0 END
      AS used_coupon,
    h.time_since_last_purchase, h.time_between_purchases, h.number_of_past_orders,
    h.order_frequency_90_days, h.average_order_value, h.std_order_value,
    h.repeat_purchase_amount, h.repeat_customer,
    CAST(w10.dpa AS BIGINT) AS distinct_product_amount,
    coalesce(cnt.b1, 0.0) AS "Brand#1_count", coalesce(cnt.b7, 0.0) AS "Brand#7_count",
    coalesce(cnt.bnan, 0.0) AS nan_count,
    coalesce(cl.email_category = 'PERSONAL', false) AS email_category_PERSONAL,
    coalesce(cl.billing_state_code = 'OR', false) AS billing_state_OR,
    coalesce(cl.billing_company_category = 'RETIREMENT', false) AS billing_company_category_RETIREMENT,
    round(sin(2 * pi() * CAST(hour(cl.ts) AS DOUBLE) / 24.0), 9) AS order_hour_sin,
    cl.order_total, cl.billing_first_name, cl.billing_last_name, cl.billing_email
  FROM cl LEFT JOIN hist h ON h.order_id = cl.order_id
  LEFT JOIN w10 ON w10.order_id = cl.order_id
  LEFT JOIN cnt ON cnt.order_id = cl.order_id)"""

ORACLE_SQL["clean_orders"] = CLEAN_SQL + """
SELECT order_id, person_id, order_year, order_hour, median_household_income,
  moe_median_household_income, is_income_censored, has_billing_company, gender_binary, used_coupon,
  time_since_last_purchase, time_between_purchases, number_of_past_orders, order_frequency_90_days,
  average_order_value, std_order_value, distinct_product_amount, repeat_customer,
  "Brand#1_count", "Brand#7_count", nan_count, email_category_PERSONAL, billing_state_OR,
  billing_company_category_RETIREMENT, order_hour_sin
FROM full_t"""

ORACLE_SQL["align_schema"] = CLEAN_SQL + """
SELECT order_id, person_id, CAST(0 AS BIGINT) AS repeat_purchase_amount, order_total,
  "Brand#1_count", email_category_PERSONAL, false AS email_category_SPACE,
  false AS payment_method_crypto, CAST(0 AS DOUBLE) AS legacy_score,
  billing_first_name, billing_last_name, billing_email
FROM full_t"""

ORACLE_SQL["serve_features"] = CLEAN_SQL + """
SELECT order_id, person_id, CAST(0 AS BIGINT) AS repeat_purchase_amount, order_total,
  "Brand#1_count", email_category_PERSONAL, false AS email_category_SPACE,
  false AS payment_method_crypto, CAST(0 AS DOUBLE) AS legacy_score, billing_email
FROM full_t"""

ORACLE_SQL["random_rows"] = """
SELECT l_orderkey, l_linenumber, target, y, score FROM (
  SELECT l_orderkey, l_linenumber, l_linestatus AS target, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         l_discount * 5 + l_tax AS score, row_number() OVER (PARTITION BY l_linestatus ORDER BY
           md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) AS k FROM lineitem)
WHERE k = 1"""

ORACLE_SQL["model_store"] = "SELECT target, (SELECT count(*) FROM orders) AS rows, CAST(0 AS BIGINT) AS differ FROM (VALUES " \
    + ", ".join(f"('{t}')" for t in TEST_SKUS[:7]) + ") AS t(target)"

ORACLE_SQL["model_input"] = CLEAN_SQL + """
SELECT order_id,
  CAST(coalesce(order_total, -1) AS FLOAT) AS order_total,
  CAST(coalesce(time_since_last_purchase, -1) AS FLOAT) AS time_since_last_purchase,
  CAST(coalesce(number_of_past_orders, -1) AS FLOAT) AS number_of_past_orders,
  CAST(coalesce(std_order_value, -1) AS FLOAT) AS std_order_value,
  CAST(coalesce(gender_binary, -1) AS FLOAT) AS gender_binary,
  CAST(coalesce("Brand#1_count", -1) AS FLOAT) AS "Brand#1_count",
  CAST(CAST(email_category_PERSONAL AS INTEGER) AS FLOAT) AS email_category_PERSONAL,
  CAST(-1 AS FLOAT) AS missing_feature
FROM full_t"""

# ------------------------------------------------------------- ranking (O2)

ORACLE_SQL["rank_top_products"] = """
WITH sc AS (
  SELECT l.l_orderkey AS order_id, p.p_brand AS target, max(l.l_discount * 5 + l.l_tax) AS score
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score DESC, target) AS rk FROM sc)
SELECT order_id, string_agg(printf('%s (%.2f)', target, score), ', ' ORDER BY rk) AS top_products
FROM r WHERE rk <= 5 GROUP BY order_id"""

# ---------------------------------------------------- samples, sinks

ORACLE_SQL["first_rows"] = _with(SCORED) + """
SELECT target, y, score FROM sc ORDER BY target, y, score LIMIT 5"""

ORACLE_SQL["report_sink"] = "WITH cr AS (" + ORACLE_SQL["class_report"] + "), pm AS (" \
    + ORACLE_SQL["pooled_metrics"] + ") " + " UNION ALL ".join(
    [f"SELECT 'lines' AS run, '{m}' AS metric, label, CAST({m} AS DOUBLE) AS value FROM cr"
     for m in ("precision", "recall", "f1", "support")]
    + [f"SELECT 'lines', '{m}', '', CAST({m} AS DOUBLE) FROM pm"
       for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro")]
    + ["SELECT 'lines', 'threshold', '', CAST(0.3 AS DOUBLE)"])

ORACLE_SQL["census_csv"] = _with(CENSUS) + " SELECT * FROM census"
ORACLE_SQL["names_csv"] = _with(NAMES) + " SELECT Name, Gender, Probability FROM names"
ORACLE_SQL["orders_csv"] = _with(ENCODED) + """
SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id, o.o_totalprice AS order_total, enc.line_items
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN enc ON enc.order_id = o.o_orderkey"""

_CATS = sorted(set(TEST_CATEGORIES.values()))
_Q = '"'
_CNT_COLS = ", ".join(f"sum(CASE WHEN sku = '{s}' THEN quantity ELSE 0 END) AS {_Q}{s}_count{_Q}"
                      for s in TEST_SKUS)
_NXT_COLS = ", ".join(f"sum(CASE WHEN sku = '{s}' THEN y ELSE 0 END) AS {_Q}next_{s}{_Q}" for s in TEST_SKUS)
_CAT_COLS = ", ".join(f"max(CASE WHEN category = '{c}' THEN present END) AS next_{c}" for c in _CATS)
_OUT_CNT = ", ".join(f"CAST(coalesce(cnt.{_Q}{s}_count{_Q}, 0) AS DOUBLE) AS {_Q}{s}_count{_Q}"
                     for s in TEST_SKUS)
_OUT_NXT = ", ".join(f"CAST(coalesce(nxl.{_Q}next_{s}{_Q}, 0) AS DOUBLE) AS {_Q}next_{s}{_Q}"
                     for s in TEST_SKUS)
_OUT_CAT = ", ".join(f"coalesce(cl.next_{c}, 0) AS next_{c}" for c in _CATS)

ORACLE_SQL["feature_sink"] = SKU_LAB + "," + HIST[HIST.index("hsrc"):] + f""",
cnt AS (SELECT order_id, {_CNT_COLS} FROM lines GROUP BY order_id),
nxl AS (SELECT order_id, {_NXT_COLS} FROM sl GROUP BY order_id),
cp AS (
  SELECT sl.order_id, c.category, CAST(sum(sl.y) > 0 AS INTEGER) AS present
  FROM sl JOIN (SELECT * FROM {_values(TEST_CATEGORIES, 'sku', 'category')}) c ON c.sku = sl.sku
  GROUP BY sl.order_id, c.category),
cl AS (SELECT order_id, {_CAT_COLS} FROM cp GROUP BY order_id)
SELECT h.person_id, h.order_id, o.o_orderdate AS order_datetime, o.o_totalprice AS order_total,
  h.time_since_last_purchase, h.time_between_purchases, h.time_since_first_purchase,
  h.number_of_past_orders, h.order_frequency_90_days, h.average_order_value, h.total_order_value,
  h.std_order_value, h.repeat_purchase_amount, h.repeat_customer_initial, h.repeat_customer,
  {_OUT_CNT}, {_OUT_NXT}, {_OUT_CAT}
FROM hist h JOIN orders o ON o.o_orderkey = h.order_id
LEFT JOIN cnt ON cnt.order_id = h.order_id
LEFT JOIN nxl ON nxl.order_id = h.order_id
LEFT JOIN cl ON cl.order_id = h.order_id"""

# ------------------------------------------------------------------ one-hot

ORACLE_SQL["one_hot"] = "SELECT c_custkey, " + ", ".join(
    f"coalesce(c_mktsegment = '{v}', false) AS c_mktsegment_{v}"
    for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer"

ORACLE_SQL["saved_levels"] = """
WITH l AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS slot
           FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 3 <> 0)),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name FROM part)
SELECT p_partkey, coalesce(slot, (SELECT count(*) FROM l))::BIGINT AS slot, (SELECT count(*) + 1 FROM l)::BIGINT AS slots
FROM p LEFT JOIN l USING (p_name)
"""

ORACLE_SQL["contract_serving"] = _with(CLEANED) + """,
tr AS (SELECT * FROM cl WHERE c_custkey % 2 = 0),
cs AS (SELECT * FROM cl WHERE c_custkey % 2 <> 0),""" + hist_sql("cs", "person_id", "order_id", "ts", "order_total") + """,
lz AS (SELECT zm, row_number() OVER (ORDER BY zm) - 1 AS slot FROM (SELECT DISTINCT zm FROM tr WHERE zm IS NOT NULL)),
ld AS (SELECT email_domain, row_number() OVER (ORDER BY email_domain) - 1 AS slot
       FROM (SELECT DISTINCT email_domain FROM tr WHERE email_domain IS NOT NULL))
SELECT cs.order_id, coalesce(lz.slot, (SELECT count(*) FROM lz))::BIGINT AS zip_slot,
       coalesce(ld.slot, (SELECT count(*) FROM ld))::BIGINT AS domain_slot, (SELECT count(*) + 1 FROM ld)::BIGINT AS domains,
       coalesce(email_category = 'PERSONAL', FALSE) AS "email_category_PERSONAL", number_of_past_orders, billing_email
FROM cs LEFT JOIN hist USING (order_id) LEFT JOIN lz ON lz.zm = cs.zm LEFT JOIN ld ON ld.email_domain = cs.email_domain
"""

ORACLE_SQL["one_hot_sparse"] = """
WITH l AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS slot FROM (SELECT DISTINCT p_name FROM part))
SELECT p_partkey, slot::BIGINT AS slot, (SELECT count(*) + 1 FROM l)::BIGINT AS slots FROM part JOIN l USING (p_name)
"""

# The exact variance is a 38-digit number; its conversion to double may differ in the last bit.
for _name in ("score_history", "history_value", "clean_orders", "feature_sink"):
    ORACLE_SQL[_name] = ("SELECT * REPLACE (round(std_order_value, 6) AS std_order_value) FROM ("
                         + ORACLE_SQL[_name] + ")")

ORACLE_SQL["items_lists"] = """
WITH o AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'id:' || o_orderkey || '|method_id:'
      || (CASE o_orderkey % 3 WHEN 0 THEN 'flat_rate' WHEN 1 THEN 'free' ELSE 'zone:4' END)
      || '|total:' || printf('%.2f', o_totalprice)
      || CASE WHEN o_orderkey % 5 = 0 THEN ';id:' || (o_orderkey + 1) || '|note|total:|status:' || o_orderstatus
           || '|status:last' ELSE '' END END AS shipping,
    CASE o_orderkey % 4 WHEN 0 THEN 'id:' || o_orderkey || '|code:c' || (o_orderkey % 10) WHEN 1 THEN NULL
      WHEN 2 THEN '' ELSE 'code:a;code:b|amount:' || (o_orderkey % 100) END AS coupon
  FROM orders),
l AS (SELECT order_id, 'shipping' AS list, shipping AS txt FROM o UNION ALL SELECT order_id, 'coupon', coupon FROM o),
r AS (SELECT order_id, list, unnest(string_split(txt, ';')) AS rec, unnest(range(len(string_split(txt, ';')))) + 1 AS slot
      FROM l WHERE txt IS NOT NULL),
f AS (SELECT order_id, list, slot, unnest(string_split(rec, '|')) AS t, unnest(range(len(string_split(rec, '|')))) AS i FROM r)
SELECT order_id, list, CAST(slot AS INTEGER) AS slot, split_part(t, ':', 1) AS key,
       arg_max(substr(t, instr(t, ':') + 1), i) AS value
FROM f WHERE instr(t, ':') > 0 GROUP BY ALL"""

ORACLE_SQL["example_predictions"] = """
WITH few AS (SELECT o_orderkey AS order_id, o_custkey AS person_id FROM orders ORDER BY o_orderkey LIMIT 5),
per AS (SELECT l_orderkey AS order_id, l_linestatus AS target, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y,
               max(l_discount * 5 + l_tax) AS score FROM lineitem GROUP BY 1, 2)
SELECT f.order_id, f.person_id, coalesce(string_agg(target, ', ' ORDER BY target) FILTER (WHERE y > 0), '') AS actual,
       coalesce(string_agg(printf('%s: %.4f', target, score), ', ' ORDER BY target), '') AS predicted
FROM few f LEFT JOIN per p ON p.order_id = f.order_id GROUP BY f.order_id, f.person_id"""

# One row per order: the next order of the person, and what was bought in it.
ORACLE_SQL["clean_orders_keyed"] = CLEAN_SQL + """,
nx AS (SELECT o_orderkey AS order_id,
         lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_id FROM orders),
bought AS (SELECT l.l_orderkey AS order_id, p.p_brand AS sku, sum(l.l_quantity) AS q
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
tot AS (SELECT nx.order_id, sum(b.q) AS next_quantity, count(*) FILTER (WHERE b.q > 0) AS next_skus
        FROM nx JOIN bought b ON b.order_id = nx.next_id GROUP BY 1)
SELECT t.order_id, t.person_id, t.repeat_customer, t.number_of_past_orders, t.distinct_product_amount, t."Brand#1_count",
  t."Brand#7_count", t.nan_count, t.email_category_PERSONAL, coalesce(tot.next_quantity, 0.0) AS next_quantity,
  CAST(coalesce(tot.next_skus, 0) AS BIGINT) AS next_skus
FROM full_t t LEFT JOIN tot USING (order_id)"""
