"""DuckDB SQL for the finance queries, written on its own terms."""

from __future__ import annotations


from tallyspark.functions.text import ACCENTED, PLAIN

_FACTS = """
orders_f AS (
    SELECT o_orderkey AS row_id, o_custkey AS account_id, o_orderdate::DATE AS date, o_totalprice::DECIMAL(22,2) * CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END AS amount, r_name AS currency,
        CASE WHEN o_orderstatus = 'O' THEN 'in' ELSE 'out' END AS direction, CASE o_orderstatus WHEN 'O' THEN 'income' WHEN 'F' THEN 'expense' ELSE 'credit_card_purchase' END AS kind,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'vivienda' WHEN '2' THEN 'servicios' WHEN '3' THEN 'alimentacion' WHEN '5' THEN 'compras' END AS category, n_name AS merchant, NULL::VARCHAR AS cost_kind, NULL::VARCHAR AS cost_confidence
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
lines_f AS (
    SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey AS account_id, l_shipdate::DATE AS date, l_extendedprice::DECIMAL(22,2) * CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS amount, r_name AS currency,
        CASE WHEN l_returnflag = 'R' THEN 'in' ELSE 'out' END AS direction, CASE WHEN l_returnflag = 'R' THEN 'refund' WHEN l_returnflag = 'A' THEN 'fee' WHEN l_linenumber = 6 THEN 'cash_advance' ELSE 'expense' END AS kind,
        CASE l_linenumber WHEN 1 THEN 'alimentacion.supermercado' WHEN 2 THEN 'vivienda.arriendo' WHEN 4 THEN 'transporte' WHEN 5 THEN 'suscripciones' END AS category, CASE WHEN l_linenumber <> 3 THEN s_name END AS merchant,
        CASE WHEN l_returnflag = 'A' THEN CASE l_linenumber % 3 WHEN 0 THEN 'maintenance' WHEN 1 THEN 'late_interest' ELSE 'credit_tax' END END AS cost_kind,
        CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber = 7 THEN 'suggested' ELSE 'confirmed' END END AS cost_confidence
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
f AS (SELECT *, strftime(date, '%Y-%m') AS month, abs(amount) AS m FROM (SELECT * FROM orders_f UNION ALL SELECT * FROM lines_f))
"""
_SPEND = "(direction = 'out' AND kind IN ('expense', 'credit_card_purchase', 'fee', 'tax', 'interest'))"
_ISSUER = "(coalesce(cost_confidence, '') = 'confirmed')"
_SUMMARY = f"""
s AS (
    SELECT *, gross_spending - refunds AS net_spending, income + refunds AS cash_inflows, income + refunds - gross_spending AS net_cash_flow,
        CASE WHEN income > 0 THEN (income::DOUBLE - (gross_spending - refunds)::DOUBLE) / income::DOUBLE END AS savings_rate
    FROM (
        SELECT currency, month, count(*) AS transaction_count,
            coalesce(sum(m) FILTER (kind = 'income' AND direction = 'in'), 0) AS income, coalesce(sum(m) FILTER (kind = 'refund'), 0) AS refunds, coalesce(sum(m) FILTER ({_SPEND}), 0) AS gross_spending,
            coalesce(sum(m) FILTER (kind IN ('expense', 'credit_card_purchase') AND cost_kind IS NULL), 0) AS consumption_spending,
            coalesce(sum(m) FILTER ({_SPEND} AND coalesce(category, '') IN ('vivienda', 'vivienda.arriendo', 'servicios', 'suscripciones')), 0) AS fixed_expenses,
            coalesce(sum(m) FILTER ({_SPEND} AND coalesce(category, '') NOT IN ('vivienda', 'vivienda.arriendo', 'servicios', 'suscripciones')), 0) AS variable_expenses,
            0 AS internal_transfers, 0 AS card_payments
        FROM f GROUP BY currency, month
    )
)
"""
_MONEY = ("income", "refunds", "gross_spending", "consumption_spending", "fixed_expenses", "variable_expenses", "internal_transfers", "card_payments", "net_spending", "cash_inflows", "net_cash_flow")


def _delta(name: str) -> str:
    a, b = f"p_{name}", name
    kind = f"CASE WHEN {a} IS NULL THEN 'no-baseline' WHEN {a} = 0 AND {b} = 0 THEN 'both-zero' WHEN {a} = 0 THEN 'new' WHEN {b} = 0 THEN 'gone' WHEN sign({a}) <> sign({b}) THEN 'sign-flip' ELSE 'relative' END"
    return f"""{kind} AS {name}_kind, CASE WHEN {kind} IN ('sign-flip', 'relative') THEN ({b} - {a})::DOUBLE END AS {name}_absolute,
        CASE WHEN {kind} = 'relative' THEN ({b}::DOUBLE - {a}::DOUBLE) / abs({a}::DOUBLE) END AS {name}_ratio"""


_PREVIOUS = ", ".join(f"CASE WHEN lag(month) OVER w = strftime(strptime(month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m') THEN lag({c}) OVER w END AS p_{c}" for c in ("month", "net_spending", "income", "net_cash_flow"))
_FOLD = f"upper(translate(replace(text, 'ß', 'ss'), '{ACCENTED}', '{PLAIN}'))"
_NORMAL = f"trim(regexp_replace({_FOLD}, '[^A-Z0-9/.*-]+', ' ', 'g'), ' ')"
_WORDS = f"regexp_replace(regexp_replace({_NORMAL}, '[0-9]+', ' ', 'g'), '[/.*-]+', ' ', 'g')"
_DESCRIBED = ("COMPRA NACIONAL SUPERMERCADO LIDER SANTIAGO", "PAGO AUTOMATICO DE CUENTAS ENEL", "TRANSFERENCIA TERCEROS JUAN", "TRASPASO ENTRE CUENTAS PROPIAS", "COMISION POR MANTENCION DE TARJETA", "INTERESES POR MORA", "MERPAGO TIENDA ROSA", "GOOGLE YOUTUBE PREMIUM", "COMPRA EN CAFE NANDU PROVIDENCIA", "PAGO TARJETA DE CREDITO", "SUELDO MARZO EMPRESA SPA", "GIRO CAJERO AUTOMATICO", "IMPUESTO TIMBRES ESTAMPILLAS", "NETFLIX COM", "FARMACIAS CRUZ VERDE CUOTA DE", "WEBPAY PLUS LIBRERIA EL SOL", "PAGO ONLINE", "SEGURO DE VIDA POLIZA", "FLOW CLASES DE PIANO", "AVANCE EN EFECTIVO")
_CANONICAL = "regexp_replace(regexp_replace(amount::VARCHAR, '0+$', ''), '\\.$', '')"
_KEYED = f"""
k AS (
    SELECT row_id, account_id, date, amount, currency, list_extract([{", ".join(repr(x) for x in _DESCRIBED)}], (row_id % 20 + 1)::INT) AS key, CASE WHEN row_id % 3 = 0 THEN row_id::VARCHAR ELSE '' END AS reference,
        {_CANONICAL} AS canonical, amount::VARCHAR AS legacy
    FROM orders_f
),
p AS (
    SELECT *, sha256(concat_ws(chr(31), 'v1', account_id, date, canonical, currency, key, reference)) AS fingerprint, sha256(concat_ws(chr(31), 'v1', 'weak', account_id, date, canonical, currency)) AS weak_fingerprint,
        CASE WHEN legacy <> canonical THEN sha256(concat_ws(chr(31), 'v1', account_id, date, legacy, currency, key, reference)) END AS legacy_fingerprint,
        CASE WHEN legacy <> canonical THEN sha256(concat_ws(chr(31), 'v1', 'weak', account_id, date, legacy, currency)) END AS legacy_weak
    FROM k
)
"""
_VERDICTS = """
old AS (SELECT CASE WHEN row_id % 2 = 0 THEN fingerprint END AS fp, weak_fingerprint AS weak, 'a' || row_id AS activity, date AS d, amount AS a, currency AS c, key || ' EXTRA' AS k, row_id % 12 = 0 AS edited, row_id AS r FROM p WHERE row_id % 3 = 0),
hit AS (SELECT p.row_id, min_by(activity, r) AS activity, min_by(edited, r) AS edited FROM p JOIN old ON fp = fingerprint GROUP BY p.row_id),
near AS (
    SELECT row_id, max_by(activity, (score, r)) AS activity, max(score) AS score
    FROM (SELECT row_id, activity, r, 1 - levenshtein(key, k)::DOUBLE / greatest(len(key), len(k)) AS score FROM p JOIN old ON weak = weak_fingerprint AND a = amount AND c = currency AND abs(date_diff('day', d, date)) <= 3) GROUP BY row_id
),
v AS (
    SELECT p.row_id, p.amount, p.currency, CASE WHEN hit.activity IS NOT NULL THEN CASE WHEN edited THEN 'host-modified' ELSE 'exact-fingerprint' END
            WHEN coalesce(score, 0) < 0.72 AND row_number() OVER (PARTITION BY fingerprint ORDER BY p.row_id) > 1 THEN 'repeated-within-file' WHEN score >= 0.72 THEN 'similar' ELSE 'new' END AS reason_code,
        hit.activity AS h, near.activity AS n, score AS s
    FROM p LEFT JOIN hit USING (row_id) LEFT JOIN near USING (row_id)
),
verdicts AS (
    SELECT row_id, amount, currency, CASE reason_code WHEN 'exact-fingerprint' THEN 'exact' WHEN 'new' THEN 'none' ELSE 'probable' END AS verdict, reason_code,
        CASE WHEN reason_code IN ('exact-fingerprint', 'host-modified') THEN h WHEN reason_code = 'similar' THEN n END AS existing_activity_id, CASE WHEN reason_code = 'similar' THEN s END AS score
    FROM v
)
"""
_PAIRS = """
e AS (
    SELECT event_id, user_id, ts::DATE AS date, round(value, 2) AS v, event_type IN ('purchase', 'error') AS is_out, event_id % 3 AS words, user_id || ':' || event_id AS leg FROM events
),
pairs AS (
    SELECT o.leg AS o_leg, i.leg AS i_leg, abs(date_diff('day', o.date, i.date)) AS gap_days, 0 IN (o.words, i.words) AS own, 1 IN (o.words, i.words) AS third
    FROM e o JOIN e i ON o.is_out AND NOT i.is_out AND o.v = i.v AND o.user_id <> i.user_id AND abs(date_diff('day', o.date, i.date)) <= 2
)
"""

ORACLES = {
    "monthly_summary": f"WITH {_FACTS}, {_SUMMARY} SELECT currency, month, transaction_count, savings_rate, {', '.join(f'{c}::DOUBLE AS {c}' for c in _MONEY)} FROM s",
    "month_comparison": f"""WITH {_FACTS}, {_SUMMARY}, c AS (SELECT *, {_PREVIOUS} FROM s WINDOW w AS (PARTITION BY currency ORDER BY month))
        SELECT currency, month, p_month AS previous_month, p_month IS NOT NULL AS comparable, {", ".join(map(_delta, ("net_spending", "income", "net_cash_flow")))} FROM c""",
    "category_totals": f"""WITH {_FACTS}, t AS (
            SELECT currency, coalesce(category, 'sin-categoria') AS category, coalesce(sum(m) FILTER (kind <> 'refund'), 0) AS gross, coalesce(sum(m) FILTER (kind = 'refund'), 0) AS refunds, count(*) AS transaction_count
            FROM f WHERE {_SPEND} OR kind = 'refund' AND category IS NOT NULL GROUP BY ALL
        ), u AS (SELECT *, gross - refunds AS amount FROM t)
        SELECT currency, category, gross::DOUBLE AS gross, refunds::DOUBLE AS refunds, amount::DOUBLE AS amount, transaction_count,
            coalesce(CASE WHEN amount > 0 THEN amount::DOUBLE / (sum(amount) FILTER (amount > 0) OVER (PARTITION BY currency))::DOUBLE END, 0) AS share,
            CASE category WHEN 'vivienda' THEN 'Vivienda' WHEN 'vivienda.arriendo' THEN 'Arriendo / dividendo' WHEN 'servicios' THEN 'Servicios básicos' WHEN 'alimentacion' THEN 'Alimentación' WHEN 'compras' THEN 'Compras'
                WHEN 'alimentacion.supermercado' THEN 'Supermercado' WHEN 'transporte' THEN 'Transporte' WHEN 'suscripciones' THEN 'Suscripciones' WHEN 'sin-categoria' THEN 'Sin categoría' END AS label,
            CASE WHEN category IN ('vivienda', 'vivienda.arriendo', 'servicios', 'suscripciones') THEN 'fixed' ELSE 'variable' END AS category_group
        FROM u""",
    "merchant_totals": f"""WITH {_FACTS}, t AS (SELECT currency, merchant, sum(m) AS amount, count(*) AS transaction_count FROM f WHERE {_SPEND} AND NOT {_ISSUER} AND merchant <> '' GROUP BY ALL)
        SELECT currency, merchant, amount::DOUBLE AS amount, transaction_count, row_number() OVER (PARTITION BY currency ORDER BY amount DESC, merchant) AS rank FROM t QUALIFY rank <= 10""",
    "unattributed_spending": f"WITH {_FACTS} SELECT currency, sum(m)::DOUBLE AS amount, count(*) AS transaction_count FROM f WHERE {_SPEND} AND NOT {_ISSUER} AND coalesce(merchant, '') = '' GROUP BY currency",
    "issuer_charges": f"WITH {_FACTS} SELECT currency, sum(m)::DOUBLE AS amount, count(*) AS transaction_count FROM f WHERE {_SPEND} AND {_ISSUER} GROUP BY currency",
    "cost_breakdown": f"""WITH {_FACTS}, t AS (SELECT *, CASE WHEN {_SPEND} AND {_ISSUER} THEN cost_kind END AS cost FROM f WHERE {_SPEND} AND {_ISSUER} OR kind = 'cash_advance' AND direction = 'out')
        SELECT currency, cost AS cost_kind, coalesce(sum(m) FILTER (cost IS NOT NULL), 0)::DOUBLE AS total, coalesce(sum(m) FILTER (cost IN ('late_interest', 'credit_tax')), 0)::DOUBLE AS borrowing,
            coalesce(sum(m) FILTER (cost = 'maintenance'), 0)::DOUBLE AS instrument, count(cost) AS transaction_count, coalesce(sum(m) FILTER (kind = 'cash_advance'), 0)::DOUBLE AS cash_advances, count(*) FILTER (kind = 'cash_advance') AS cash_advance_count
        FROM t GROUP BY GROUPING SETS ((currency), (currency, cost)) HAVING grouping(cost) = 1 OR cost IS NOT NULL""",
    "recurring_charges": f"""WITH {_FACTS}, days AS (
            SELECT currency, 'CLIENTE ' || account_id AS merchant_key, account_id % 2 = 0 AS mandated, date, sum(-amount) AS amount, count(*) AS charges FROM orders_f WHERE amount < 0 GROUP BY ALL
        ), gaps AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY currency, merchant_key ORDER BY date), date) AS gap FROM days),
        g AS (
            SELECT currency, merchant_key, any_value(mandated) AS mandated, count(*) AS occurrences, sum(charges)::BIGINT AS charge_count, max(charges) AS most, min(gap) AS lo, max(gap) AS hi, quantile_disc(gap, 0.5) AS mid, quantile_disc(amount, 0.5) AS typical,
                list(amount) AS amounts, min(date) AS first_date, max(date) AS last_date FROM gaps GROUP BY ALL
        ), h AS (SELECT *, list_max(list_transform(amounts, lambda x: abs(x - typical) * 10000)) AS worst, list_max(list_transform(amounts, lambda x: abs(x::DOUBLE - typical::DOUBLE) / typical::DOUBLE)) AS spread FROM g),
        r AS (SELECT *, lo >= 1 AND hi <= 900 AND worst <= typical * 6000 AS regular FROM h)
        SELECT merchant_key, currency, typical::DOUBLE AS typical_amount, occurrences, charge_count, mid AS median_interval_days, lo AS min_interval_days, hi AS max_interval_days, spread AS amount_spread, first_date, last_date,
            CASE WHEN mandated THEN 'pac' END AS mandate, CASE WHEN regular AND most = 1 AND mandated AND occurrences >= 3 THEN 'likely' ELSE 'possible' END AS confidence
        FROM r WHERE occurrences >= CASE WHEN mandated THEN 2 ELSE 3 END AND lo >= 1 AND hi <= 1500 AND worst <= typical * 15000 AND (occurrences >= 3 OR regular)""",
    "transfer_candidates": f"WITH {_PAIRS} SELECT o_leg, i_leg, gap_days, CASE WHEN own THEN 2 WHEN third THEN 1 ELSE 0 END AS rank, third AS third_party FROM pairs",
    "transfer_candidates_all": """WITH e AS (SELECT *, ts::DATE AS date, round(value, 2) AS v, event_type IN ('purchase', 'error') AS is_out, event_id % 3 AS words, user_id || ':' || event_id AS leg FROM events)
        SELECT o.leg AS o_leg, i.leg AS i_leg, abs(date_diff('day', o.date, i.date)) AS gap_days, CASE WHEN 0 IN (o.words, i.words) THEN 2 WHEN 1 IN (o.words, i.words) THEN 1 ELSE 0 END AS rank, 1 IN (o.words, i.words) AS third_party
        FROM e o JOIN e i ON o.is_out AND NOT i.is_out AND o.v = i.v AND o.user_id <> i.user_id AND abs(date_diff('day', o.date, i.date)) <= 5""",
    "fingerprints": f"WITH {_FACTS}, {_KEYED} SELECT row_id, fingerprint, weak_fingerprint, legacy_fingerprint FROM p",
    "duplicates": f"WITH {_FACTS}, {_KEYED}, {_VERDICTS} SELECT row_id, verdict, reason_code, existing_activity_id, score FROM verdicts",
    "import_totals": f"""WITH {_FACTS}, {_KEYED}, {_VERDICTS}, t AS (SELECT v.*, o.kind, abs(v.amount) AS m, row_id % 11 = 0 AS ignored, row_id % 7 = 0 AS sure FROM verdicts v JOIN orders_f o USING (row_id)),
        u AS (SELECT *, NOT ignored AND verdict = 'none' AS chosen FROM t)
        SELECT currency, count(*) AS rows, count(*) FILTER (chosen) AS to_import, count(*) FILTER (verdict = 'exact') AS exact_duplicates, count(*) FILTER (verdict = 'probable') AS probable_duplicates,
            count(*) FILTER (reason_code = 'host-modified') AS host_modified_duplicates, count(*) FILTER (ignored) AS ignored, coalesce(sum(m) FILTER (chosen AND kind = 'income'), 0)::DOUBLE AS income,
            coalesce(sum(m) FILTER (chosen AND kind <> 'income'), 0)::DOUBLE AS expenses, 0::DOUBLE AS internal_transfers, 0::DOUBLE AS card_payments, 0 AS unknown_kind, 0 AS needs_review,
            (coalesce(sum(m) FILTER (chosen AND kind = 'income'), 0) - coalesce(sum(m) FILTER (chosen AND kind <> 'income'), 0))::DOUBLE AS net
        FROM u GROUP BY currency""",
    "idempotency_keys": "SELECT event_id AS source_line, k || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS idempotency_key FROM (SELECT event_id, user_id || ':' || event_type AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)",
    "rule_cases": """WITH t AS (SELECT p_partkey, upper(p_type) AS d, round(p_retailprice, 2) AS p FROM part), a AS (SELECT *, p >= 1500 AND contains(d, 'BRASS') AS a FROM t), b AS (SELECT *, a AS b, NOT a AND (p BETWEEN 1000 AND 1200 OR starts_with(d, 'STANDARD')) AS c FROM a),
        c AS (SELECT *, NOT a AND regexp_matches(d, '\\bTIN$') AS x FROM b)
        SELECT p_partkey, CASE WHEN a THEN 'Herrero' END AS merchant, CASE WHEN a THEN 'metal' WHEN c THEN 'normal' END AS category, concat_ws(',', CASE WHEN a THEN 'caro' END, CASE WHEN x THEN 'estaño' END) AS tags,
            concat_ws(',', CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN c THEN 'c' END, CASE WHEN x THEN 'd' END) AS applied_rules, x AS ignored FROM c""",
    "text_keys": f"""SELECT doc_id, sha256({_NORMAL}) AS normal, sha256(trim(regexp_replace(regexp_replace({_WORDS}, '\\b[A-Z]\\b', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS key,
        len(list_filter(regexp_split_to_array({_NORMAL}, '[ /.*-]+'), lambda x: x <> '')) AS tokens FROM documents""",
    "calendar": """SELECT o_orderkey, strftime(d, '%Y-%m') AS month, strftime(date_trunc('month', d) + INTERVAL 5 MONTH, '%Y-%m') AS later, (d + INTERVAL 1 MONTH)::DATE AS next_month, last_day(d) AS month_end,
        date_diff('day', d, DATE '1998-08-02') AS days FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""",
    "date_readings": """SELECT o_orderkey, d AS date, o_orderkey % 3 <> 1 AND day(d) <= 12 AND day(d) <> month(d) AS ambiguous, NULL::VARCHAR AS error FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""",
    "date_orders": """WITH t AS (SELECT o_custkey % 50 AS file, CASE WHEN o_custkey % 2 = 0 THEN day(o_orderdate) ELSE month(o_orderdate) END AS a, CASE WHEN o_custkey % 2 = 0 THEN month(o_orderdate) ELSE day(o_orderdate) END AS b FROM orders),
        g AS (SELECT file, bool_or(a > 12 AND b <= 12) AS dmy, bool_or(b > 12 AND a <= 12) AS mdy, count(*) FILTER (a <= 12 AND b <= 12 AND a <> b) AS n FROM t GROUP BY file)
        SELECT file, CASE WHEN dmy AND mdy THEN 'DMY' WHEN mdy THEN 'MDY' ELSE 'DMY' END AS date_order, CASE WHEN dmy AND mdy THEN 'conflict' WHEN dmy OR mdy THEN 'file' ELSE 'profile' END AS source,
            CASE WHEN dmy <> mdy THEN 0 ELSE n END AS ambiguous_rows FROM g""",
    "balance_walk": f"""WITH {_FACTS}, r AS (SELECT account_id, row_id, sum(amount) OVER (PARTITION BY account_id ORDER BY row_id) AS run FROM orders_f),
        m AS (SELECT account_id, run, run + CASE WHEN row_id % 10 = 0 THEN 1 ELSE 0 END AS bal, row_id FROM r WHERE row_id % 2 = 0),
        d AS (SELECT account_id, lag(bal) OVER w + run - lag(run) OVER w <> bal AS off FROM m WINDOW w AS (PARTITION BY account_id ORDER BY row_id))
        SELECT account_id, count(off) AS steps, count(*) FILTER (off) AS mismatches, count(off) >= 4 AND count(*) FILTER (off) * 2 >= count(off) AS systematic FROM d GROUP BY account_id""",
    "bag_diff": """WITH t AS (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL)
        SELECT user_id, event_type, least(a, b) AS matched, a - least(a, b) AS only_a, b - least(a, b) AS only_b FROM t""",
}
