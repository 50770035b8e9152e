"""Queries over users, contracts, payments and ledgers."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import business as b
from ..operators import changes, identity, ledgers, reports, validation
from ..sources import schemas, zones
from ..sources.views import VIEWS
from .registry import Tables, query

CONTRACTS = """c AS (
  SELECT e.*, coalesce(u.pages_used, 0)::BIGINT AS pages_used, total_pages * unit_price AS total_cost, greatest(0.0, total_pages * unit_price - advance_bill) AS due_amount,
    CASE WHEN greatest(0.0, total_pages * unit_price - advance_bill) <= 0 THEN 'paid' WHEN advance_bill > 0 THEN 'partial_paid' ELSE 'due' END AS payment_status,
    CASE WHEN end_date >= start_date THEN end_date - start_date END AS duration_days, greatest(0, total_pages - coalesce(u.pages_used, 0))::BIGINT AS pages_remaining
  FROM enterprises e LEFT JOIN (SELECT enterprise_id, sum(total_pages)::BIGINT AS pages_used FROM enterprise_ocr_documents GROUP BY 1) u ON u.enterprise_id = e.id)"""


def contracts(t: Tables) -> DataFrame:
    return reports.contracts(t.enterprises, t.enterprise_ocr_documents)


@query("b1_balances", """SELECT id, greatest(0, 3 - free_ocr_used) AS free_remaining, greatest(0, subscription_pages_total - subscription_pages_used) AS pages_remaining,
  subscription_pages_total > subscription_pages_used AS active FROM users""")
def b1(t: Tables) -> DataFrame:
    left = b.pages_remaining(F.col("subscription_pages_total"), F.col("subscription_pages_used"))
    return t.users.select("id", b.free_remaining(F.col("free_ocr_used")).alias("free_remaining"), left.alias("pages_remaining"), (left > 0).alias("active"))


@query("b2_quota_status", """WITH u AS (SELECT id, role IN ('super_user', 'admin') AS above, free_ocr_used AS fu, greatest(0, 3 - free_ocr_used) AS f, subscription_pages_total AS st, subscription_pages_used AS su,
  greatest(0, subscription_pages_total - subscription_pages_used) AS p FROM users)
SELECT id, 3 AS free_ocr_limit, if(above, 0, fu) AS free_ocr_used, if(above, 3, f) AS free_ocr_remaining, if(above, 0, st) AS subscription_pages_total, if(above, 0, su) AS subscription_pages_used,
  if(above, 0, p) AS subscription_pages_remaining, NOT above AND p > 0 AS has_active_subscription, above OR f > 0 OR p > 0 AS can_do_ocr,
  CASE WHEN above THEN 'Unlimited OCR access (admin / super-user).' WHEN f > 0 THEN 'You have ' || f || ' free OCR request(s) remaining.' WHEN p > 0 THEN 'You have ' || p || ' subscription page(s) remaining.'
    ELSE 'You have used all your free OCR requests and your subscription pages are exhausted. Please subscribe to continue.' END AS message FROM u""")
def b2(t: Tables) -> DataFrame:
    told = b.quota_snapshot(F.col("role"), F.col("free_ocr_used"), F.col("subscription_pages_total"), F.col("subscription_pages_used"))
    return t.users.select("id", *[c.alias(name) for name, c in told.items()])


@query("b3_b8_page_prices", "SELECT id, pages_purchased * 10 AS cost, payment_amount / pages_purchased AS unit_price FROM payment_history")
def b3(t: Tables) -> DataFrame:
    return t.payment_history.select("id", b.page_cost(F.col("pages_purchased")).alias("cost"), b.unit_price(F.col("payment_amount"), F.col("pages_purchased")).alias("unit_price"))


@query("b4_b5_b7_contracts", f"WITH {CONTRACTS} SELECT id, total_cost, total_cost - advance_bill AS due_at_creation, due_amount, payment_status, duration_days, pages_used, pages_remaining FROM c")
def b4(t: Tables) -> DataFrame:
    return contracts(t).select("id", "total_cost", b.contract_due(F.col("total_cost"), F.col("advance_bill"), False).alias("due_at_creation"), "due_amount", "payment_status", "duration_days", "pages_used", "pages_remaining")


@query("b6_payments_posted", f"""WITH {CONTRACTS}, p AS (SELECT l_partkey AS id, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS paid FROM lineitem GROUP BY 1), a AS (
  SELECT c.id, CASE WHEN paid IS NULL THEN advance_bill ELSE round(advance_bill + paid, 2) END AS advance_bill, CASE WHEN paid IS NULL THEN due_amount ELSE round(greatest(0.0, total_cost - round(advance_bill + paid, 2)), 2) END AS due_amount
  FROM c LEFT JOIN p ON p.id = c.id) SELECT *, CASE WHEN due_amount <= 0 THEN 'paid' WHEN advance_bill > 0 THEN 'partial_paid' ELSE 'due' END AS payment_status FROM a""")
def b6(t: Tables) -> DataFrame:
    return changes.payments_posted(contracts(t), t.lineitem.select(F.col("l_partkey").alias("enterprise_id"), F.col("l_extendedprice").alias("amount")))


@query("b9_invoice_numbers", """SELECT id, 'ENT-' || CASE WHEN id > 999999 THEN id::VARCHAR ELSE lpad(id::VARCHAR, 6, '0') END AS contract_no, user_id || '-' || upper(substr(sha256(id::VARCHAR), 1, 12)) AS payment_no, user_id AS parsed FROM payment_history""")
def b9(t: Tables) -> DataFrame:
    number = b.payment_invoice(F.col("user_id"), F.col("id"))
    return t.payment_history.select("id", b.contract_invoice(F.col("id")).alias("contract_no"), number.alias("payment_no"), b.invoice_user(number).alias("parsed"))


#: Summer time of the years of the test data, in UTC: the first Sunday of April to the last of October in New York, the
#: last Sundays of March and October in London (of 1995, the 22nd of October).
ZONED = """WITH p AS (SELECT id, created_at + to_minutes(CAST(id * 7 % 1440 AS INT)) AS moment, year(created_at) AS y, CASE id % 5 WHEN 0 THEN 'Asia/Dhaka' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/London' WHEN 3 THEN 'Nowhere/At all' END AS z FROM payment_history),
  s AS (SELECT *, make_date(y, 4, 1) + ((7 - dayofweek(make_date(y, 4, 1))) % 7)::INT AS april, make_date(y, 3, 31) - dayofweek(make_date(y, 3, 31))::INT AS march,
    make_date(y, 10, 31) - dayofweek(make_date(y, 10, 31))::INT AS october FROM p),
  o AS (SELECT id, moment, CASE z WHEN 'Asia/Dhaka' THEN 360 WHEN 'America/New_York' THEN CASE WHEN moment >= april + INTERVAL 7 HOUR AND moment < october + INTERVAL 6 HOUR THEN -240 ELSE -300 END
    WHEN 'Europe/London' THEN CASE WHEN moment >= march + INTERVAL 1 HOUR AND moment < CASE WHEN y = 1995 THEN DATE '1995-10-22' ELSE october END + INTERVAL 1 HOUR THEN 60 ELSE 0 END ELSE 0 END AS minutes, z FROM s)
SELECT id, strftime(moment + to_minutes(minutes), '%B %d, %Y') AS day, strftime(moment + to_minutes(minutes), '%I:%M %p ') ||
  CASE z WHEN 'Asia/Dhaka' THEN '+06' WHEN 'America/New_York' THEN if(minutes = -240, 'EDT', 'EST') WHEN 'Europe/London' THEN if(minutes = 60, 'BST', 'GMT') ELSE 'UTC' END AS clock FROM o"""


@query("b10_local_time", ZONED)
def b10(t: Tables) -> DataFrame:
    zone = F.when(F.col("id") % 5 == 0, "Asia/Dhaka").when(F.col("id") % 5 == 1, "America/New_York").when(F.col("id") % 5 == 2, "Europe/London").when(F.col("id") % 5 == 3, "Nowhere/At all")
    moment = F.expr("timestampadd(MINUTE, CAST(id * 7 % 1440 AS INT), created_at)").cast("timestamp")
    day, clock = b.local_time(F.col("moment"), F.col("offset"), F.col("abbreviation"))
    return zones.with_zone(t.payment_history.select("id", moment.alias("moment"), zone.alias("asked")), "moment", "asked").select("id", day.alias("day"), clock.alias("clock"))


@query("b11_b13_names", r"""SELECT id, coalesce(full_name, username) AS display, coalesce(nullif(substr(regexp_replace(coalesce(replace(full_name, ' ', '_'), split_part(email, '@', 1)), '[^a-zA-Z0-9_]', '', 'g'), 1, 40), ''), 'user') AS base FROM users""")
def b11(t: Tables) -> DataFrame:
    return t.users.select("id", b.display_name(F.col("full_name"), F.col("username")).alias("display"), b.username_base(F.col("full_name"), F.col("email")).alias("base"))


@query("b12_fingerprints", "SELECT request_id, sha256(ip_address || '|' || coalesce(accept_language, 'unknown') || '|unknown') AS fingerprint FROM trial_requests")
def b12(t: Tables) -> DataFrame:
    return t.trial_requests.select("request_id", b.fingerprint(F.col("ip_address"), F.col("accept_language"), F.lit("")).alias("fingerprint"))


@query("b14_permissions", "SELECT id, CASE role WHEN 'super_user' THEN 3 WHEN 'admin' THEN 2 ELSE 1 END AS rank, role IN ('super_user', 'admin') AS may FROM users")
def b14(t: Tables) -> DataFrame:
    return t.users.select("id", b.rank(F.col("role")).alias("rank"), b.permitted(F.col("role"), F.lit("admin")).alias("may"))


DEVICES = """d AS (SELECT f AS device_id, count(*) % 4 AS used, count(*) % 5 = 0 AS locked FROM (SELECT sha256(ip_address || '|' || coalesce(accept_language, 'unknown') || '|unknown') AS f FROM trial_requests) GROUP BY 1)"""


@query("b17_trial_status", f"""WITH {DEVICES}, k AS (SELECT DISTINCT 'device-' || user_id AS device_id FROM ocr_requests UNION ALL SELECT device_id FROM d)
SELECT device_id, coalesce(used, 0)::BIGINT AS usage_count, 3 AS max_usage, (CASE WHEN used IS NULL THEN 3 WHEN locked THEN 0 ELSE greatest(0, 3 - used) END)::BIGINT AS remaining, locked AS is_blocked, used IS NULL AS is_new FROM k LEFT JOIN d USING (device_id)""")
def b17(t: Tables) -> DataFrame:
    """Known devices, and as many that no one knows as users ask."""
    known = devices(t)
    unknown = t.ocr_requests.select(F.concat(F.lit("device-"), F.col("user_id").cast("string")).alias("device_id"))
    return identity.trial_status(known.select("device_id").unionByName(unknown), known)


@query("b17_trial_attempts", f"""WITH {DEVICES} SELECT device_id, NOT locked AND used < 3 AS allowed, CASE WHEN locked OR used >= 3 THEN used ELSE used + 1 END AS usage_count, CASE WHEN locked OR used >= 3 THEN 0 ELSE 2 - used END AS remaining,
  CASE WHEN locked THEN 'Your device has been blocked. Please contact support or register for an account.' WHEN used >= 3 THEN 'Free trial limit reached. Please register to continue using our service.'
    WHEN used = 2 THEN 'This was your last free trial. Please register to continue.' WHEN used = 1 THEN 'You have 1 free trial remaining. Register to get unlimited access.' ELSE 'You have ' || (2 - used) || ' free trials remaining.' END AS message FROM d""")
def b17_attempts(t: Tables) -> DataFrame:
    return identity.trial_attempts(devices(t))


def visits(t: Tables) -> DataFrame:
    print_ = b.fingerprint(F.col("ip_address"), F.col("accept_language"), F.lit(None).cast("string"))
    return t.trial_requests.select("request_id", "requested_at", print_.alias("fingerprint"), "cookie_id")


def devices(t: Tables) -> DataFrame:
    counted = visits(t).groupBy(F.col("fingerprint").alias("device_id")).agg(F.count("*").alias("n"), F.min("cookie_id").alias("cookie_id"))
    return counted.select("device_id", (F.col("n") % 4).alias("usage_count"), F.lit(3).alias("max_usage"), (F.col("n") % 5 == 0).alias("is_blocked"), "cookie_id")


EMAIL = r"^[A-Za-z0-9._%+''-]+@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"


def told(*fields: str) -> str:
    """The first broken rule of each field, as text, of the rules in SQL that each field lists."""
    return f"list_filter([{', '.join(f'CASE {f} END' for f in fields)}], lambda x: x IS NOT NULL)"


def broken(when: str, field: str, message: str, kind: str) -> str:
    return f"WHEN {when} THEN '{field}: {message} [{kind}]'"


def required(field: str) -> str:
    return broken(f"{field} IS NULL", f"body -> {field}", "Field required", "missing")


def too_short(field: str, n: int, words: str) -> str:
    return broken(f"length({field}) < {n}", f"body -> {field}", f"String should have at least {words}", "string_too_short")


def too_long(field: str, n: int) -> str:
    return broken(f"length({field}) > {n}", f"body -> {field}", f"String should have at most {n} characters", "string_too_long")


def too_small(field: str) -> str:
    return broken(f"{field} < 0", f"body -> {field}", "Input should be greater than or equal to 0", "greater_than_equal")


def no_address(field: str) -> str:
    return broken(f"NOT regexp_matches({field}, '{EMAIL}')", f"body -> {field}", "value is not a valid email address", "value_error")


def no_pages(field: str) -> str:
    return broken(f"{field} <= 0", f"body -> {field}", "Input should be greater than 0", "greater_than")


CONTRACT_FORMS = f"""SELECT id, CASE WHEN len(v) > 0 THEN v WHEN end_date < start_date THEN ['body: Value error, end_date must be on or after start_date [value_error]']
    WHEN coalesce(advance_bill, 0) > total_pages * coalesce(unit_price, 10) THEN ['body: Value error, advance_bill (' || coalesce(advance_bill, 0)::DOUBLE || ') cannot exceed total cost (' || (total_pages * coalesce(unit_price, 10))::DOUBLE || ') [value_error]'] ELSE v END AS v
  FROM (SELECT *, {told(
    required('name') + ' ' + too_short('name', 1, '1 character') + ' ' + too_long('name', 255), too_long('phone', 50), no_address('email'),
    required('total_pages') + ' ' + broken('total_pages < 1', 'body -> total_pages', 'Input should be greater than or equal to 1', 'greater_than_equal'), too_small('unit_price'), too_small('advance_bill'), too_small('no_of_documents'),
    broken("payment_status NOT IN ('paid', 'partial_paid', 'due')", 'body -> payment_status', "Input should be ''paid'', ''partial_paid'' or ''due''", 'enum'),
  )} AS v FROM contract_forms)"""
PAYMENT_FORMS = f"""SELECT id, {told(
    required('pages') + ' ' + no_pages('pages'), required('cust_name') + ' ' + too_short('cust_name', 2, '2 characters') + ' ' + too_long('cust_name', 100),
    required('cust_phone') + ' ' + too_short('cust_phone', 7, '7 characters') + ' ' + too_long('cust_phone', 20), too_long('cust_address', 255),
  )} AS v FROM payment_forms"""
ACCOUNT_FORMS = f"""SELECT id, {told(
    required('username') + ' ' + too_short('username', 3, '3 characters') + ' ' + too_long('username', 50), required('email') + ' ' + no_address('email'), too_long('full_name', 255),
    broken("role NOT IN ('super_user', 'admin', 'user')", 'body -> role', "Input should be ''super_user'', ''admin'' or ''user''", 'enum'),
  )} AS v FROM account_forms"""
PLAN_FORMS = f"SELECT id, {told(required('pages') + ' ' + no_pages('pages'))} AS v FROM payment_forms"


def verdicts(rows: DataFrame, form: str) -> DataFrame:
    """id, n, told: both outputs of the split, put together again."""
    valid, refused = validation.split(rows, form)
    words = F.transform("violations", lambda v: F.concat(v["field"], F.lit(": "), v["message"], F.lit(" ["), v["type"], F.lit("]")))
    return valid.select("id", F.lit(0).alias("n"), F.lit("").alias("told")).unionByName(refused.select("id", F.size("violations").alias("n"), F.array_join(words, "; ").alias("told")))


def verdicts_sql(forms: str) -> str:
    return f"SELECT id, len(v) AS n, array_to_string(v, '; ') AS told FROM ({forms})"


@query("v1_violations", verdicts_sql(CONTRACT_FORMS))
def v1_contracts(t: Tables) -> DataFrame:
    return verdicts(t.contract_forms, "contract")


@query("v1_payments", verdicts_sql(PAYMENT_FORMS))
def v1_payments(t: Tables) -> DataFrame:
    return verdicts(t.payment_forms, "payment")


@query("v1_accounts", verdicts_sql(ACCOUNT_FORMS))
def v1_accounts(t: Tables) -> DataFrame:
    return verdicts(t.account_forms, "account")


@query("v1_plans", verdicts_sql(PLAN_FORMS))
def v1_plans(t: Tables) -> DataFrame:
    return verdicts(t.payment_forms, "plan")


@query("b4_created", """SELECT id, total_pages * coalesce(unit_price, 10.0) AS total_cost, total_pages * coalesce(unit_price, 10.0) - coalesce(advance_bill, 0.0) AS due_amount,
  CASE WHEN end_date >= start_date THEN end_date - start_date END AS duration_days, coalesce(payment_status, 'due') AS payment_status, 0 AS pages_used FROM contract_forms""")
def b4_created(t: Tables) -> DataFrame:
    return changes.created(t.contract_forms).select("id", "total_cost", "due_amount", "duration_days", "payment_status", "pages_used")


@query("e1_billing_summary", f"""WITH {CONTRACTS} SELECT count(*) AS total_enterprises, sum(total_pages)::BIGINT AS total_pages, sum(total_cost::DECIMAL(18,2))::DOUBLE AS total_cost, sum(advance_bill::DECIMAL(18,2))::DOUBLE AS total_advance,
  sum(due_amount::DECIMAL(18,2))::DOUBLE AS total_due, count(*) FILTER (payment_status = 'paid') AS paid_count, count(*) FILTER (payment_status = 'partial_paid') AS partial_paid_count, count(*) FILTER (payment_status = 'due') AS due_count FROM c WHERE NOT is_deleted""")
def e1(t: Tables) -> DataFrame:
    return reports.billing_summary(contracts(t))


@query("e2_portfolio", f"""WITH {CONTRACTS}, s AS (SELECT created_by AS id, count(*) AS contracts, sum(total_pages)::BIGINT AS allocated, sum(pages_used)::BIGINT AS used, sum(advance_bill::DECIMAL(18,2))::DOUBLE AS revenue_collected,
  sum(due_amount::DECIMAL(18,2))::DOUBLE AS due, count(*) FILTER (payment_status = 'paid') AS paid_count, count(*) FILTER (payment_status = 'partial_paid') AS partial_paid_count, count(*) FILTER (payment_status = 'due') AS due_count FROM c WHERE NOT is_deleted GROUP BY 1), d AS (SELECT user_id AS id, count(*) AS documents FROM ocr_documents WHERE NOT is_deleted GROUP BY 1)
SELECT u.id, coalesce(contracts, 0) AS contracts, coalesce(allocated, 0) AS allocated, coalesce(used, 0) AS used, coalesce(revenue_collected, 0) AS revenue_collected, coalesce(due, 0) AS due,
  coalesce(paid_count, 0) AS paid_count, coalesce(partial_paid_count, 0) AS partial_paid_count, coalesce(due_count, 0) AS due_count,
  coalesce(documents, 0) AS documents, greatest(0, coalesce(allocated, 0) - coalesce(used, 0)) AS remaining FROM users u LEFT JOIN s ON s.id = u.id LEFT JOIN d ON d.id = u.id WHERE role <> 'user'""")
def e2(t: Tables) -> DataFrame:
    return reports.portfolio(t.users.where("role <> 'user'"), contracts(t), t.ocr_documents)


@query("e3_e7_e8_platform", f"""WITH {CONTRACTS}, p AS (SELECT count(*) AS total_users, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'admin') AS admins, count(*) FILTER (role = 'super_user') AS super_users,
  count(*) FILTER (subscription_pages_total > subscription_pages_used) AS active_subscriptions FROM users), l AS (SELECT count(*) AS documents FROM ocr_documents WHERE NOT is_deleted),
  r AS (SELECT sum(payment_amount::DECIMAL(18,2))::DOUBLE AS subscription_revenue FROM payment_history WHERE status = 'success'),
  e AS (SELECT count(*) AS enterprises, sum(advance_bill::DECIMAL(18,2))::DOUBLE AS enterprise_revenue_collected, sum(due_amount::DECIMAL(18,2))::DOUBLE AS enterprise_due FROM c WHERE NOT is_deleted),
  f AS (SELECT count(DISTINCT sha256(ip_address || '|' || coalesce(accept_language, 'unknown') || '|unknown')) AS free_trial_users FROM trial_requests) SELECT * FROM p, l, r, e, f""")
def e3(t: Tables) -> DataFrame:
    return reports.platform(t.users, t.ocr_documents, t.payment_history, contracts(t), devices(t))


@query("e4_user_stats", """SELECT u.id, coalesce(n, 0) AS documents, coalesce(p, 0) AS pages, latest_file, latest_at, greatest(0, 3 - free_ocr_used) AS free_remaining, greatest(0, subscription_pages_total - subscription_pages_used) AS pages_remaining
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n, sum(total_pages)::BIGINT AS p, arg_max(filename, (created_at, id)) AS latest_file, max(created_at) AS latest_at FROM ocr_documents WHERE NOT is_deleted GROUP BY 1) d ON d.user_id = u.id""")
def e4(t: Tables) -> DataFrame:
    return reports.user_stats(t.users, t.ocr_documents)


@query("e6_s5_pages_used", "SELECT e.id, coalesce(sum(d.total_pages), 0)::BIGINT AS pages_used FROM enterprises e LEFT JOIN enterprise_ocr_documents d ON d.enterprise_id = e.id GROUP BY 1")
def e6(t: Tables) -> DataFrame:
    """New contracts, and all documents appended to them."""
    return changes.appended(t.enterprises.withColumn("pages_used", F.lit(0)), t.enterprise_ocr_documents).select("id", "pages_used")


@query("w1_e5_newest_page", """SELECT id, filename, created_at, (SELECT count(*) FROM ocr_documents WHERE NOT is_deleted) AS total FROM ocr_documents WHERE NOT is_deleted ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20""")
def w1(t: Tables) -> DataFrame:
    live = t.ocr_documents.where("not is_deleted")
    page = reports.page_of(live.select("id", "filename", "created_at"), [F.desc("created_at"), F.desc("id")], 50, 20)
    return page.crossJoin(live.agg(F.count("*").alias("total")))  # one row


@query("w2_page_per_owner", """SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM ocr_documents WHERE NOT is_deleted) WHERE place BETWEEN 3 AND 5""")
def w2(t: Tables) -> DataFrame:
    return reports.page_per_owner(t.ocr_documents.where("not is_deleted"), "user_id", [F.desc("created_at"), F.desc("id")], 3, 2).select("user_id", "id", "place")


@query("w3_page_by_id", "SELECT id, username FROM users ORDER BY id LIMIT 100")
def w3(t: Tables) -> DataFrame:
    return reports.page_of(t.users.select("id", "username"), [F.asc("id")], 100)


@query("w4_page_numbers", "SELECT user_id, ceil(n / 3)::BIGINT AS total_pages, 2 < ceil(n / 3) AS has_next, true AS has_prev FROM (SELECT user_id, count(*) AS n FROM ocr_documents GROUP BY 1)")
def w4(t: Tables) -> DataFrame:
    return t.ocr_documents.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", *reports.page_numbers(F.col("n"), F.lit(2), F.lit(3)))


@query("w5_latest_per_key", "SELECT user_id, id, filename FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM ocr_documents) WHERE n = 1")
def w5(t: Tables) -> DataFrame:
    return reports.newest(t.ocr_documents.select("user_id", "id", "filename", "created_at"), "user_id", ["created_at", "id"]).select("user_id", "id", "filename")


@query("f1_keyed_fetch", "SELECT id, username, 'found' AS state FROM users WHERE id IN (SELECT user_id FROM ocr_requests) UNION ALL SELECT DISTINCT user_id, NULL, 'missing' FROM ocr_requests WHERE user_id NOT IN (SELECT id FROM users)")
def f1(t: Tables) -> DataFrame:
    keys = t.ocr_requests.select(F.col("user_id").alias("id"))
    gone = reports.missing(keys, t.users, "id").select("id", F.lit(None).cast("string").alias("username"), F.lit("missing").alias("state"))
    return reports.fetched(t.users, keys, "id").select("id", "username", F.lit("found").alias("state")).unionByName(gone)


@query("f2_visibility", """SELECT u.id AS caller_id, count(*) AS documents, sum(d.id)::BIGINT AS id_sum FROM users u JOIN ocr_documents d ON u.role = 'super_user' OR (d.user_id = u.id AND NOT d.is_deleted) GROUP BY 1""")
def f2(t: Tables) -> DataFrame:
    return reports.visible_totals(t.users, t.ocr_documents)


@query("f3_f5_filters", """SELECT 'status' AS filter, count(*) AS n FROM payment_history WHERE status = 'failed' UNION ALL SELECT 'bad status', count(*) FROM payment_history
UNION ALL SELECT 'mode', count(*) FROM ocr_documents WHERE lang = 'fr' UNION ALL SELECT 'no mode', count(*) FROM ocr_documents UNION ALL SELECT 'regular', count(*) FROM users WHERE role = 'user'""")
def f3(t: Tables) -> DataFrame:
    status = ("pending", "success", "failed", "cancelled")
    frames = {"status": reports.by_enum(t.payment_history, "status", "failed", status), "bad status": reports.by_enum(t.payment_history, "status", "odd", status), "mode": reports.by_mode(t.ocr_documents, "lang", "fr"), "no mode": reports.by_mode(t.ocr_documents, "lang", ""), "regular": t.users.where("role = 'user'")}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("filter"), "n") for name, df in frames.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("j1_creator", "SELECT e.id, coalesce(full_name, username) AS created_by_name FROM enterprises e LEFT JOIN users u ON u.id = e.created_by")
def j1(t: Tables) -> DataFrame:
    return reports.with_creator(t.enterprises, t.users).select("id", "created_by_name")


@query("j2_processor", "SELECT processed_by, coalesce(full_name, username) AS processor_name, count(*) AS documents FROM enterprise_ocr_documents d LEFT JOIN users u ON u.id = d.processed_by GROUP BY ALL")
def j2(t: Tables) -> DataFrame:
    return reports.with_creator(t.enterprise_ocr_documents, t.users, "processed_by", "processor_name").groupBy("processed_by", "processor_name").agg(F.count("*").alias("documents"))


@query("j3_contract_history", """SELECT u.id AS caller_id, count(*) AS documents, sum(d.total_pages)::BIGINT AS pages FROM users u JOIN enterprises e ON (u.role = 'super_user' OR (e.created_by = u.id AND NOT e.is_deleted))
JOIN enterprise_ocr_documents d ON d.enterprise_id = e.id WHERE u.role <> 'user' GROUP BY 1""")
def j3(t: Tables) -> DataFrame:
    callers = t.users.where("role <> 'user'")
    return reports.contract_totals(callers, t.enterprises, t.enterprise_ocr_documents)


NEW = "new AS (SELECT o_orderkey AS id, 'user' || (o_custkey % 400) AS username, 'u' || (o_orderkey % 3000) || '@example.com' AS email FROM orders)"


def registrations(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("user"), (F.col("o_custkey") % 400).cast("string")).alias("username"), F.concat(F.lit("u"), (F.col("o_orderkey") % 3000).cast("string"), F.lit("@example.com")).alias("email"))


@query("j5_conflicts", f"""WITH {NEW}, free AS (SELECT * FROM new WHERE username NOT IN (SELECT username FROM users) AND email NOT IN (SELECT email FROM users)),
  f AS (SELECT list_reduce(list({{'i': id, 'u': username, 'e': email}} ORDER BY id), lambda acc, x: CASE WHEN list_contains(acc.us, x.u) OR list_contains(acc.es, x.e) THEN acc
    ELSE {{'us': list_append(acc.us, x.u), 'es': list_append(acc.es, x.e), 'ids': list_append(acc.ids, x.i)}} END, {{'us': []::VARCHAR[], 'es': []::VARCHAR[], 'ids': []::BIGINT[]}}) AS a FROM free),
  taken AS (SELECT unnest(a.ids) AS id, unnest(a.us) AS username, unnest(a.es) AS email FROM f)
SELECT new.id, CASE WHEN new.username IN (SELECT username FROM users) OR u.id < new.id THEN 'username' WHEN new.email IN (SELECT email FROM users) OR e.id < new.id THEN 'email' END AS conflict
FROM new LEFT JOIN taken u ON u.username = new.username LEFT JOIN taken e ON e.email = new.email""")
def j5(t: Tables) -> DataFrame:
    return identity.conflicts(registrations(t), t.users)


@query("j6_linked", """WITH l AS (SELECT event_id AS login_id, 'g' || (event_id % 900) AS x, 'u' || (event_id % 2500) || '@example.com' AS m, 'Login ' || (event_id % 7) AS nm FROM events),
  g AS (SELECT map_from_entries(list((k, v)) FILTER (k IS NOT NULL)) AS by_id, map_from_entries(list((id, k)) FILTER (k IS NOT NULL)) AS cur, map_from_entries(list((email, id))) AS mail, map_from_entries(list((id, full_name))) AS nm FROM (SELECT id, email, full_name, CASE WHEN id % 2 = 0 THEN 'g' || id END AS k, id AS v FROM users)),
  s AS (SELECT list({'i': login_id, 'x': x, 'm': m, 'n': nm} ORDER BY login_id) AS steps FROM l),
  f AS (SELECT list_reduce(steps, lambda acc, e: CASE WHEN acc.by_id[e.x] IS NOT NULL AND acc.cur[acc.by_id[e.x]] = e.x THEN {'by_id': acc.by_id, 'cur': acc.cur, 'mail': acc.mail, 'nm': acc.nm, 'out': list_append(acc.out, {'l': e.i, 'a': 'by id', 'u': acc.by_id[e.x], 'n': acc.nm[acc.by_id[e.x]]})}
    WHEN acc.mail[e.m] IS NOT NULL THEN {'by_id': map_concat(acc.by_id, MAP([e.x], [acc.mail[e.m]])), 'cur': map_concat(acc.cur, MAP([acc.mail[e.m]], [e.x])), 'mail': acc.mail,
      'nm': map_concat(acc.nm, MAP([acc.mail[e.m]], [coalesce(acc.nm[acc.mail[e.m]], e.n)])), 'out': list_append(acc.out, {'l': e.i, 'a': 'by email', 'u': acc.mail[e.m], 'n': coalesce(acc.nm[acc.mail[e.m]], e.n)})}
    ELSE {'by_id': map_concat(acc.by_id, MAP([e.x], [-1 - e.i])), 'cur': map_concat(acc.cur, MAP([-1 - e.i], [e.x])), 'mail': map_concat(acc.mail, MAP([e.m], [-1 - e.i])), 
      'nm': map_concat(acc.nm, MAP([-1 - e.i], [e.n])), 'out': list_append(acc.out, {'l': e.i, 'a': 'new', 'u': -1 - e.i, 'n': e.n})} END,
    {'by_id': by_id, 'cur': cur, 'mail': mail, 'nm': nm, 'out': []::STRUCT(l BIGINT, a VARCHAR, u BIGINT, n VARCHAR)[]}) AS r FROM g, s)
SELECT o.l AS login_id, o.a AS action, CASE WHEN o.u >= 0 THEN o.u END AS user_id, CASE WHEN o.u < 0 THEN -1 - o.u END AS opened_by, o.n AS full_name FROM (SELECT unnest(r.out) AS o FROM f)""")
def j6(t: Tables) -> DataFrame:
    text = lambda head, mod, tail="": F.concat(F.lit(head), (F.col("event_id") % mod).cast("string"), F.lit(tail))
    logins = t.events.select(F.col("event_id").alias("login_id"), text("g", 900).alias("external_id"), text("u", 2500, "@example.com").alias("email"), text("Login ", 7).alias("full_name"))
    accounts = t.users.withColumn("google_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("g"), F.col("id").cast("string"))))
    return identity.linked(logins, accounts).select("login_id", "action", "user_id", "opened_by", "full_name")


@query("j7_free_names", """WITH n AS (SELECT c_custkey AS id, 'name_' || chr((97 + c_custkey % 20)::INT) AS base FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM n),
  taken AS (SELECT 'name_' || chr((97 + s_suppkey % 20)::INT) || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE (s_suppkey % 7)::VARCHAR END AS username FROM supplier), bases AS (SELECT base, max(k) AS m FROM r GROUP BY 1),
  tries AS (SELECT base, s, base || CASE WHEN s = 0 THEN '' ELSE s::VARCHAR END AS username FROM bases, unnest(range(0, m + 10)) AS q(s)), free AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY s) AS k FROM tries WHERE username NOT IN (SELECT username FROM taken))
SELECT r.id, free.username FROM r JOIN free ON free.base = r.base AND free.k = r.k""")
def j7(t: Tables) -> DataFrame:
    letter = lambda c: F.concat(F.lit("name_"), F.char((97 + F.col(c) % 20).cast("long")))
    suffix = F.when(F.col("s_suppkey") % 7 == 0, "").otherwise((F.col("s_suppkey") % 7).cast("string"))
    return identity.free_names(t.customer.select(F.col("c_custkey").alias("id"), letter("c_custkey").alias("base")), t.supplier.select(F.concat(letter("s_suppkey"), suffix).alias("username")))


@query("w6_codes", """WITH RECURSIVE c AS (SELECT event_id, ts, user_id % 50 AS email, (event_id % 3)::VARCHAR AS code, event_id % 4 = 0 AS is_code FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, event_id) AS n FROM c),
  f AS (SELECT email, n, event_id, is_code, CASE WHEN is_code THEN code END AS current, CASE WHEN is_code THEN ts END AS issued, CASE WHEN is_code THEN NULL ELSE 'none' END AS outcome FROM a WHERE n = 1
  UNION ALL SELECT a.email, a.n, a.event_id, a.is_code, CASE WHEN a.is_code THEN a.code WHEN f.current IS NULL OR a.ts > f.issued + INTERVAL 6 HOUR OR a.code = f.current THEN NULL ELSE f.current END,
    CASE WHEN a.is_code THEN a.ts ELSE f.issued END, CASE WHEN a.is_code THEN NULL WHEN f.current IS NULL THEN 'none' WHEN a.ts > f.issued + INTERVAL 6 HOUR THEN 'expired' WHEN a.code <> f.current THEN 'wrong' ELSE 'ok' END
  FROM f JOIN a ON a.email = f.email AND a.n = f.n + 1) SELECT event_id AS attempt_id, outcome FROM f WHERE NOT is_code""")
def w6(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", (F.col("user_id") % 50).cast("string").alias("email"), (F.col("event_id") % 3).cast("string").alias("code"))
    codes = e.where("event_id % 4 = 0").select("email", "code", F.col("ts").alias("issued_at"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"))
    typed = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), "code", F.lit("\t"))).otherwise(F.col("code"))  # white space around a code is not part of it
    return identity.code_outcomes(codes, e.where("event_id % 4 <> 0").select(F.col("event_id").alias("attempt_id"), "email", typed.alias("code"), F.col("ts").alias("at")))


@query("s7_partial_update", f"""WITH {CONTRACTS} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE start_date END AS start_date, CASE WHEN id % 2 = 0 THEN 7.5 ELSE unit_price END AS unit_price,
  total_pages * CASE WHEN id % 2 = 0 THEN 7.5 ELSE unit_price END AS total_cost, greatest(0.0, total_pages * CASE WHEN id % 2 = 0 THEN 7.5 ELSE unit_price END - advance_bill) AS due_amount, CASE WHEN id % 3 <> 0 THEN duration_days END AS duration_days, payment_status FROM c""")
def s7(t: Tables) -> DataFrame:
    fields = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "unit_price"), F.when(F.col("id") % 3 == 0, "start_date")))
    changed = t.enterprises.where("id % 2 = 0 or id % 3 = 0").select("id", fields.alias("set_fields"), F.lit(7.5).alias("unit_price"), F.lit(None).cast("date").alias("start_date"))
    return changes.rederived(changes.updated(contracts(t), changed, "id", ["unit_price", "start_date"])).select("id", "start_date", "unit_price", "total_cost", "due_amount", "duration_days", "payment_status")


#: Requests to delete: of documents' owners and of others, of super users, and of documents that aren't there.
ASKED = """k AS (SELECT id, CASE WHEN id % 20 = 0 THEN user_id ELSE user_id + 1 END AS caller_id, false AS privileged FROM ocr_documents WHERE id % 10 = 0
  UNION ALL SELECT id, 0, true FROM ocr_documents WHERE id % 25 = 0 UNION ALL SELECT -1 - id, user_id, id % 2 = 0 FROM ocr_documents WHERE id % 15 = 0),
  mine AS (SELECT k.*, d.id IS NOT NULL AND (k.privileged OR k.caller_id = d.user_id) AS found FROM k LEFT JOIN ocr_documents d ON d.id = k.id)"""


def asked(t: Tables) -> DataFrame:
    d = t.ocr_documents
    own = F.when(F.col("id") % 20 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1)
    return (
        d.where("id % 10 = 0").select("id", own.alias("caller_id"), F.lit(False).alias("privileged"))
        .unionByName(d.where("id % 25 = 0").select("id", F.lit(0).cast("long").alias("caller_id"), F.lit(True).alias("privileged")))
        .unionByName(d.where("id % 15 = 0").select((-1 - F.col("id")).alias("id"), F.col("user_id").alias("caller_id"), (F.col("id") % 2 == 0).alias("privileged")))
    )


@query("s8_deletes", f"WITH {ASKED} SELECT id, is_deleted OR id IN (SELECT id FROM mine WHERE found) AS is_deleted FROM ocr_documents WHERE id NOT IN (SELECT id FROM mine WHERE found AND id % 3 = 0)")
def s8(t: Tables) -> DataFrame:
    """Own documents are marked; of those, every third is removed for good."""
    marked = changes.soft_deleted(t.ocr_documents, asked(t), "id", "user_id")
    return changes.hard_deleted(marked, asked(t).where("id % 3 = 0"), "id", "user_id").select("id", "is_deleted")


@query("s8_replies", f"WITH {ASKED} SELECT id, caller_id, CASE WHEN found THEN 'deleted' ELSE 'not_found' END AS reply FROM mine")
def s8_replies(t: Tables) -> DataFrame:
    return changes.delete_replies(t.ocr_documents, asked(t), "id", "user_id")


@query("s2_s10_conformed", "SELECT id, username, coalesce(full_name, '') AS full_name, 'local' AS auth_provider, free_ocr_used::BIGINT AS free_ocr_used, NULL::TIMESTAMP AS last_login FROM users")
def s10(t: Tables) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id long, username string, full_name string, auth_provider string, free_ocr_used long, last_login timestamp_ntz")
    return changes.conformed(t.users, schema, {"full_name": F.lit(""), "auth_provider": F.lit("local")})


def declared(t: Tables, name: str) -> DataFrame:
    """A view written as one of the declared tables and scanned as such."""
    made = {"hashed_password": None, "auth_provider": "local", "is_verified": True, "created_at": NOON, "file_type": "pdf", "file_size": 1, "ocr_mode": "english", "ocr_engine": "docai", "languages": ["en"], "extracted_text": "",
            "filename": "file", "confidence": 0.0, "total_pages": 1, "user_id": 0, "total_cost": 0.0, "due_amount": 0.0, "payment_status": "due", "no_of_documents": 0, "pages_used": 0, "usage_count": 0, "max_usage": 3, "first_used_at": NOON,
            "is_blocked": False, "is_used": False, "user_data": "{}", "is_deleted": False}
    rows = getattr(t, name) if name in VIEWS else MADE[name](t)
    path = t.folder(name)
    schemas.conformed(rows, name, **{k: v for k, v in made.items() if k in schemas.schema_of(name).names}).write.parquet(path)
    return schemas.table(t.spark, path, name)


NOON = datetime.datetime(2024, 1, 1, 12)
MADE = {
    "free_trial_users": lambda t: devices(t).select(F.crc32("device_id").alias("id"), "device_id", "usage_count", "max_usage", "is_blocked", "cookie_id"),
    "email_otps": lambda t: t.events.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("@example.com")).alias("email"), (F.col("event_id") % 1_000_000).cast("string").alias("otp_code"), F.col("ts").alias("expires_at")),
}


@query("s2_users", "SELECT count(*) AS n, sum(id)::BIGINT AS ids, count(full_name) AS named, 0::BIGINT AS logins, sum(free_ocr_used)::BIGINT AS used, count(*) FILTER (is_active) AS active FROM users")
def s2_users(t: Tables) -> DataFrame:
    return declared(t, "users").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count("full_name").alias("named"), F.count("last_login").alias("logins"), F.sum("free_ocr_used").alias("used"), F.count_if("is_active").alias("active"))


@query("s2_ocr_documents", "SELECT ocr_engine, count(*) AS n, sum(id)::BIGINT AS ids, sum(length(extracted_text))::BIGINT AS characters, count(*) FILTER (is_deleted) AS deleted FROM ocr_documents GROUP BY 1")
def s2_documents(t: Tables) -> DataFrame:
    return declared(t, "ocr_documents").groupBy("ocr_engine").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.length("extracted_text")).alias("characters"), F.count_if("is_deleted").alias("deleted"))


@query("s2_enterprises", "SELECT created_by, count(*) AS n, sum(total_pages)::BIGINT AS pages, count(start_date) AS starts, max(end_date) AS last_end FROM enterprises GROUP BY 1")
def s2_enterprises(t: Tables) -> DataFrame:
    return declared(t, "enterprises").groupBy("created_by").agg(F.count("*").alias("n"), F.sum("total_pages").alias("pages"), F.count("start_date").alias("starts"), F.max("end_date").alias("last_end"))


@query("s2_enterprise_documents", "SELECT processed_by, count(*) AS n, sum(total_pages)::BIGINT AS pages FROM enterprise_ocr_documents GROUP BY 1")
def s2_enterprise_documents(t: Tables) -> DataFrame:
    return declared(t, "enterprise_ocr_documents").groupBy("processed_by").agg(F.count("*").alias("n"), F.sum("total_pages").alias("pages"))


@query("s2_payments", "SELECT status, count(*) AS n, sum(pages_purchased)::BIGINT AS pages, count(DISTINCT invoice_number) AS invoices FROM payment_history GROUP BY 1")
def s2_payments(t: Tables) -> DataFrame:
    return declared(t, "payment_history").groupBy("status").agg(F.count("*").alias("n"), F.sum("pages_purchased").alias("pages"), F.count_distinct("invoice_number").alias("invoices"))


@query("s2_trial_users", f"WITH {DEVICES} SELECT device_id, used AS usage_count, locked AS is_blocked FROM d")
def s2_trial_users(t: Tables) -> DataFrame:
    return declared(t, "free_trial_users").select("device_id", F.col("usage_count").cast("long").alias("usage_count"), "is_blocked")


@query("s2_codes", "SELECT event_type || '@example.com' AS email, count(*) AS n, count(DISTINCT event_id % 1000000) AS codes FROM events GROUP BY 1")
def s2_codes(t: Tables) -> DataFrame:
    return declared(t, "email_otps").groupBy("email").agg(F.count("*").alias("n"), F.count_distinct("otp_code").alias("codes"))


@query("p1_settlement", """WITH j AS (SELECT k.*, h.id AS pid, h.payment_amount, h.status AS before, h.pages_purchased FROM payment_callbacks k LEFT JOIN payment_history h USING (invoice_number)), l AS (SELECT *, CASE WHEN pid IS NULL THEN 'not found'
  WHEN abs(reported_amount - payment_amount) > 0.01 THEN 'amount mismatch' WHEN lower(trim(reported_status)) NOT IN ('successful', 'success', '1', '200') THEN CASE WHEN lower(trim(reported_status)) = 'failed' THEN 'failed' ELSE 'cancelled' END ELSE 'success' END AS look FROM j)
SELECT callback_id, invoice_number, CASE WHEN pid IS NULL THEN 'not found' WHEN before = 'success' OR coalesce(max((look = 'success')::INT) OVER (PARTITION BY invoice_number ORDER BY received_at, callback_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'duplicate' ELSE look END AS outcome FROM l""")
def p1(t: Tables) -> DataFrame:
    return ledgers.settled(t.payment_callbacks, t.payment_history, t.users).select("callback_id", "invoice_number", "outcome")


SETTLED = """j AS (SELECT k.*, h.id AS pid, h.user_id AS payer, h.payment_amount, h.status AS before, h.pages_purchased FROM payment_callbacks k JOIN payment_history h USING (invoice_number)), l AS (SELECT *, CASE WHEN abs(reported_amount - payment_amount) > 0.01 THEN 'failed'
  WHEN lower(trim(reported_status)) = 'failed' THEN 'failed' WHEN lower(trim(reported_status)) <> 'successful' THEN 'cancelled' ELSE 'success' END AS look FROM j WHERE before <> 'success'), o AS (SELECT invoice_number, any_value(payer) AS payer, any_value(pages_purchased) AS pages,
  min(received_at) FILTER (look = 'success') AS paid_at, arg_max(look, (received_at, callback_id)) AS last FROM l GROUP BY 1)"""


@query("p1_final_status", f"WITH {SETTLED} SELECT id, h.invoice_number, CASE WHEN paid_at IS NOT NULL THEN 'success' ELSE coalesce(last, status) END AS status, paid_at FROM payment_history h LEFT JOIN o USING (invoice_number)")
def p1_final(t: Tables) -> DataFrame:
    return ledgers.final_status(ledgers.settled(t.payment_callbacks, t.payment_history, t.users), t.payment_history)


@query("p1_credits", f"WITH {SETTLED} SELECT payer AS user_id, sum(pages)::BIGINT AS pages, count(*) AS payments FROM o WHERE paid_at IS NOT NULL GROUP BY 1")
def p1_credits(t: Tables) -> DataFrame:
    return ledgers.credits(ledgers.settled(t.payment_callbacks, t.payment_history, t.users))


@query("p2_initiated", """SELECT id AS payment_id, CASE WHEN id % 5 = 0 OR (id % 3 <> 0 AND id % 4 <> 0) THEN 'failed' ELSE 'pending' END AS status, CASE WHEN id % 3 = 0 THEN 'https://pay/' || id WHEN id % 4 = 0 THEN 'https://go/' || id END AS url FROM payment_history""")
def p2(t: Tables) -> DataFrame:
    code = F.when(F.col("id") % 5 == 0, "400").otherwise("200")
    url = lambda head, mod: F.when(F.col("id") % mod == 0, F.concat(F.lit(head), F.col("id").cast("string")))
    reply = F.to_json(F.struct(code.alias("status_code"), url("https://pay/", 3).alias("payment_url"), url("https://go/", 4).alias("redirectGatewayURL")))
    return ledgers.initiated(t.payment_history.select(F.col("id").alias("payment_id"), reply.alias("reply")))


@query("p3_eligible", "SELECT id, role = 'user' AS may_pay FROM users")
def p3(t: Tables) -> DataFrame:
    return t.users.select("id", (F.col("role") == "user").alias("may_pay"))


@query("i1_subscription_invoice", """WITH p AS (SELECT invoice_number, pages_purchased, currency || ' ' || round(payment_amount / pages_purchased, 2)::DECIMAL(18,2)::VARCHAR AS unit, currency || ' ' || payment_amount::DECIMAL(18,2)::VARCHAR AS paid FROM payment_history)
SELECT invoice_number, unnest([0, 1, 2, 3, 4, 5]) AS line, unnest(['pages', 'unit price', 'amount', 'subtotal', 'tax', 'total']) AS label, unnest([pages_purchased::VARCHAR, unit, paid, paid, 'Included', paid]) AS value FROM p""")
def i1(t: Tables) -> DataFrame:
    return ledgers.subscription_invoice(t.payment_history)


@query("i2_contract_invoices", f"""WITH {CONTRACTS}, v AS (SELECT id, list_filter([{{'label': 'allocation', 'value': total_pages::VARCHAR}}, {{'label': 'used', 'value': pages_used::VARCHAR}}, {{'label': 'remaining', 'value': pages_remaining::VARCHAR}},
  CASE WHEN id % 5 > 0 THEN {{'label': 'documents', 'value': (id % 5)::VARCHAR}} END, {{'label': 'contract value', 'value': total_cost::DECIMAL(18,2)::VARCHAR}}, {{'label': 'advance', 'value': advance_bill::DECIMAL(18,2)::VARCHAR}}, {{'label': 'due', 'value': due_amount::DECIMAL(18,2)::VARCHAR}},
  CASE WHEN duration_days IS NOT NULL THEN {{'label': 'duration', 'value': duration_days::VARCHAR}} END, {{'label': 'status', 'value': upper(replace(payment_status, '_', ' '))}}], lambda x: x IS NOT NULL) AS items FROM c)
SELECT 'ENT-' || lpad(id::VARCHAR, greatest(6, length(id::VARCHAR))::INTEGER, '0') AS invoice_number, i AS line, items[i + 1].label AS label, items[i + 1].value AS value FROM (SELECT id, items, unnest(range(0, len(items))) AS i FROM v)""")
def i2(t: Tables) -> DataFrame:
    return ledgers.contract_invoices(contracts(t).withColumn("no_of_documents", F.col("id") % 5))


REQUESTS = "(SELECT * FROM ocr_requests WHERE file_size > 0 AND file_size <= 104857600)"


def credited(t: Tables) -> DataFrame:
    """Purchases, as the callbacks settle them."""
    paid = ledgers.settled(t.payment_callbacks, t.payment_history, t.users).where("outcome = 'success'")
    return paid.select(F.col("payer").alias("user_id"), F.col("callback_id").alias("credit_id"), F.col("received_at").alias("paid_at"), F.col("pages_purchased").alias("pages"))


LEDGER = """e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY moment, kind, event_id) AS n FROM ev), f AS (SELECT k, n, event_id, kind, CASE WHEN kind = 1 AND free > 0 AND pages = 1 THEN free - 1 ELSE free END AS free,
    CASE WHEN kind = 0 THEN bal + pages WHEN free > 0 THEN bal WHEN pages <= bal THEN bal - pages ELSE bal END AS bal, CASE WHEN kind = 0 THEN NULL WHEN free > 0 AND pages > 1 THEN '400' WHEN free > 0 THEN 'free' WHEN pages <= bal THEN 'paid' ELSE '402' END AS decision FROM e WHERE n = 1
  UNION ALL SELECT e.k, e.n, e.event_id, e.kind, CASE WHEN e.kind = 1 AND f.free > 0 AND e.pages = 1 THEN f.free - 1 ELSE f.free END, CASE WHEN e.kind = 0 THEN f.bal + e.pages WHEN f.free > 0 THEN f.bal WHEN e.pages <= f.bal THEN f.bal - e.pages ELSE f.bal END,
    CASE WHEN e.kind = 0 THEN NULL WHEN f.free > 0 AND e.pages > 1 THEN '400' WHEN f.free > 0 THEN 'free' WHEN e.pages <= f.bal THEN 'paid' ELSE '402' END FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)"""


@query("q1_t5_user_quota", f"""WITH RECURSIVE {SETTLED}, u AS (SELECT id AS k, role, greatest(0, 3 - free_ocr_used)::BIGINT AS free, (subscription_pages_total - subscription_pages_used)::BIGINT AS bal FROM users), ev AS (
  SELECT k, requested_at AS moment, 1 AS kind, request_id AS event_id, pages_needed::BIGINT AS pages, free, bal FROM {REQUESTS} JOIN u ON k = user_id WHERE role = 'user'
  UNION ALL SELECT k, paid_at, 0, 0, pages, free, bal FROM o JOIN u ON k = payer WHERE role = 'user' AND paid_at IS NOT NULL), {LEDGER}
SELECT k AS key, event_id, decision FROM f WHERE kind = 1 UNION ALL SELECT k, request_id, 'unlimited' FROM {REQUESTS} JOIN u ON k = user_id WHERE role <> 'user'""")
def q1(t: Tables) -> DataFrame:
    return ledgers.user_quota(t.ocr_requests.where("file_size > 0 and file_size <= 104857600"), t.users, credited(t))


@query("q2_contract_quota", f"""WITH RECURSIVE ev AS (SELECT p.id AS k, requested_at AS moment, 1 AS kind, request_id AS event_id, (pages_needed * 7)::BIGINT AS pages, 0::BIGINT AS free, greatest(0, p.total_pages - p.total_pages * 4 // 5)::BIGINT AS bal
  FROM ocr_requests r JOIN enterprises p ON p.id = r.request_id % greatest(1, (SELECT CAST(floor(count(*) / 10) AS BIGINT) FROM enterprises))), {LEDGER} SELECT k AS key, event_id, decision FROM f""")
def q2(t: Tables) -> DataFrame:
    asked = F.broadcast(t.enterprises.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("asked")))  # one row
    requests = t.ocr_requests.crossJoin(asked).select((F.col("request_id") % F.col("asked")).alias("enterprise_id"), "requested_at", "request_id", (F.col("pages_needed") * 7).alias("pages"))
    return ledgers.contract_quota(requests, t.enterprises.select("id", F.col("total_pages").alias("total"), F.expr("total_pages * 4 div 5").alias("used")))


@query("q3_trials", """WITH v AS (SELECT request_id, requested_at, sha256(ip_address || '|' || coalesce(accept_language, 'unknown') || '|unknown') AS device_id, CASE WHEN request_id % 6 = 0 THEN 2 ELSE 1 END AS pages FROM trial_requests),
  d AS (SELECT device_id, count(*) AS n FROM v GROUP BY 1), j AS (SELECT v.*, n % 4 AS used, n % 5 = 0 AS b FROM v JOIN d USING (device_id))
SELECT request_id, device_id, CASE WHEN pages > 1 THEN '400' WHEN b THEN 'blocked' WHEN sum((NOT b AND pages <= 1)::INT) OVER (PARTITION BY device_id ORDER BY requested_at, request_id ROWS UNBOUNDED PRECEDING) + used <= 3 THEN 'ok' ELSE '403' END AS decision FROM j""")
def q3(t: Tables) -> DataFrame:
    requests = visits(t).select("request_id", "requested_at", F.col("fingerprint").alias("device_id"), F.when(F.col("request_id") % 6 == 0, 2).otherwise(1).alias("pages"))
    return ledgers.trial(requests, devices(t))


#: Visits one after the other: a device by its fingerprint, else by its cookie, which gives it the new fingerprint, else a new one.
IDENTITIES = """WITH v AS (SELECT request_id, requested_at, sha256(ip_address || '|' || coalesce(accept_language, 'unknown') || '|unknown') AS f, cookie_id FROM trial_requests),
  s AS (SELECT list({'i': request_id, 'f': f, 'c': coalesce(cookie_id, '')} ORDER BY requested_at, request_id) AS steps FROM v),
  r AS (SELECT list_reduce(steps, lambda acc, e: list_transform([{'p': acc.prints[e.f], 'q': acc.cookies[e.c]}], lambda k:
    CASE WHEN k.p IS NOT NULL THEN {'prints': acc.prints,
        'cookies': CASE WHEN e.c <> '' AND acc.devices[k.p].c = '' AND k.q IS NULL THEN map_concat(acc.cookies, MAP([e.c], [k.p])) ELSE acc.cookies END,
        'devices': CASE WHEN e.c <> '' AND acc.devices[k.p].c = '' THEN map_concat(acc.devices, MAP([k.p], [{'f': acc.devices[k.p].f, 'p': acc.devices[k.p].p, 'c': e.c}])) ELSE acc.devices END,
        'out': list_append(acc.out, {'i': e.i, 'd': acc.devices[k.p].f, 'o': k.p, 'n': false})}
      WHEN e.c <> '' AND k.q IS NOT NULL THEN {'prints': map_concat(acc.prints, MAP([acc.devices[k.q].p, e.f], [NULL::BIGINT, k.q])), 'cookies': acc.cookies,
        'devices': map_concat(acc.devices, MAP([k.q], [{'f': acc.devices[k.q].f, 'p': e.f, 'c': acc.devices[k.q].c}])), 'out': list_append(acc.out, {'i': e.i, 'd': acc.devices[k.q].f, 'o': k.q, 'n': false})}
      ELSE {'prints': map_concat(acc.prints, MAP([e.f], [e.i])), 'cookies': CASE WHEN e.c <> '' THEN map_concat(acc.cookies, MAP([e.c], [e.i])) ELSE acc.cookies END,
        'devices': map_concat(acc.devices, MAP([e.i], [{'f': e.f, 'p': e.f, 'c': e.c}])), 'out': list_append(acc.out, {'i': e.i, 'd': e.f, 'o': e.i, 'n': true})} END)[1],
    {'prints': MAP([]::VARCHAR[], []::BIGINT[]), 'cookies': MAP([]::VARCHAR[], []::BIGINT[]), 'devices': MAP([]::BIGINT[], []::STRUCT(f VARCHAR, p VARCHAR, c VARCHAR)[]),
      'out': []::STRUCT(i BIGINT, d VARCHAR, o BIGINT, n BOOLEAN)[]}) AS a FROM s)
SELECT o.i AS request_id, o.d AS device, o.o AS opened_by, o.n AS is_new FROM (SELECT unnest(a.out) AS o FROM r)"""


@query("q4_trial_identities", IDENTITIES)
def q4(t: Tables) -> DataFrame:
    return identity.trial_identities(visits(t))


#: Answers one after the other; the cookies of all devices are looked up at the time of each.
CONSENTS = """v AS (SELECT request_id, requested_at, sha256(ip_address || '|' || coalesce(accept_language, 'unknown') || '|unknown') AS f, cookie_id FROM trial_requests),
  d AS (SELECT map_from_entries(list((f, {'c': c, 'g': NULL::BOOLEAN, 't': NULL::TIMESTAMP}))) AS dev FROM (SELECT f, min(cookie_id) AS c FROM v GROUP BY f)),
  s AS (SELECT list({'i': request_id, 'f': CASE WHEN request_id % 3 = 0 THEN 'other' ELSE f END, 'c': cookie_id, 'g': request_id % 4 <> 0, 't': requested_at} ORDER BY requested_at, request_id) AS steps FROM v),
  r AS (SELECT list_reduce(steps, lambda acc, e: list_transform([CASE WHEN acc.dev[e.f] IS NOT NULL THEN e.f
      WHEN e.c IS NOT NULL THEN list_min(list_transform(list_filter(map_entries(acc.dev), lambda x: x.value.c = e.c), lambda x: x.key)) END],
    lambda k: {'dev': CASE WHEN k IS NULL THEN acc.dev ELSE map_concat(acc.dev, MAP([k], [{'c': CASE WHEN e.g THEN coalesce(e.c, acc.dev[k].c) END, 'g': e.g, 't': e.t}])) END,
      'out': list_append(acc.out, {'i': e.i, 'k': k})})[1], {'dev': dev, 'out': []::STRUCT(i BIGINT, k VARCHAR)[]}) AS a FROM d, s)"""


def answers(t: Tables) -> DataFrame:
    print_ = F.when(F.col("request_id") % 3 == 0, "other").otherwise(F.col("fingerprint"))
    return visits(t).select(F.col("request_id").alias("answer_id"), print_.alias("fingerprint"), "cookie_id", (F.col("request_id") % 4 != 0).alias("given"), F.col("requested_at").alias("at"))


@query("q5_consents", f"WITH {CONSENTS} SELECT e.key AS device_id, e.value.g AS consent_given, e.value.t AS consent_at, e.value.c AS cookie_id FROM (SELECT unnest(map_entries(a.dev)) AS e FROM r)")
def q5(t: Tables) -> DataFrame:
    return identity.consents(devices(t), answers(t))


@query("q5_replies", f"WITH {CONSENTS} SELECT o.i AS answer_id, o.k AS device_id, CASE WHEN o.k IS NULL THEN 404 ELSE 200 END AS reply FROM (SELECT unnest(a.out) AS o FROM r)")
def q5_replies(t: Tables) -> DataFrame:
    return identity.answered(devices(t), answers(t))


@query("q6_blocked", """WITH d AS (SELECT sha256(ip_address || '|' || coalesce(accept_language, 'unknown') || '|unknown') AS device_id, count(*) AS n, bool_or(request_id % 100 = 0) AS b FROM trial_requests GROUP BY 1) SELECT device_id, n % 5 = 0 OR b AS is_blocked FROM d""")
def q6(t: Tables) -> DataFrame:
    return identity.blocked(devices(t), visits(t).where("request_id % 100 = 0").select(F.col("fingerprint").alias("device_id"))).select("device_id", "is_blocked")
