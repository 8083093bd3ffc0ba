"""DuckDB SQL for statements, plans, matching, insights and readings of descriptions, written on its own terms."""

from __future__ import annotations

from tallyspark.plans.oracles import _FACTS, _ISSUER, _KEYED, _SPEND, _SUMMARY, _VERDICTS
from tallyspark.sources.profiles import PROFILES

# What a reader makes of each invented description, by its place: processor, merchant, confidence, source, why unresolved.
_READINGS = """
readings(i, description, processor_id, merchant_name, merchant_confidence, merchant_source, unresolved) AS (VALUES
    (0, 'COMPRA NACIONAL SUPERMERCADO LIDER SANTIAGO', NULL, 'Lider', 'confirmed', 'brand-alias', NULL),
    (1, 'Pago automático de cuentas ENEL', NULL, 'Enel', 'confirmed', 'brand-alias', NULL),
    (2, 'TRANSFERENCIA A TERCEROS JUAN', NULL, 'Terceros Juan', 'suggested', 'residual-text', NULL),
    (3, 'Traspaso entre cuentas propias', NULL, 'Traspaso Entre Cuentas Propias', 'suggested', 'residual-text', NULL),
    (4, 'COMISION POR MANTENCION DE TARJETA', NULL, 'Comision POR Mantencion de Tarjeta', 'suggested', 'residual-text', NULL),
    (5, 'INTERESES POR MORA', NULL, 'Intereses POR Mora', 'suggested', 'residual-text', NULL),
    (6, 'MERPAGO*TIENDA ROSA', 'mercado-pago', NULL, NULL, NULL, 'processor-hides-merchant'),
    (7, 'GOOGLE *YOUTUBE PREMIUM', 'google', 'Youtube Premium', 'suggested', 'processor-grammar', NULL),
    (8, 'Compra en Café Ñandú 123456 PROVIDENCIA', NULL, 'Cafe Nandu', 'suggested', 'residual-text', NULL),
    (9, 'PAGO TARJETA DE CREDITO', NULL, 'Tarjeta de Credito', 'suggested', 'residual-text', NULL),
    (10, 'SUELDO MARZO EMPRESA SPA', NULL, 'Sueldo Marzo Empresa SPA', 'suggested', 'residual-text', NULL),
    (11, 'GIRO CAJERO AUTOMATICO', NULL, NULL, NULL, NULL, 'bank-placeholder'),
    (12, 'IMPUESTO TIMBRES Y ESTAMPILLAS', NULL, 'Impuesto Timbres Y Estampillas', 'suggested', 'residual-text', NULL),
    (13, 'NETFLIX.COM 02/12', NULL, 'Netflix', 'confirmed', 'brand-alias', NULL),
    (14, 'FARMACIAS CRUZ VERDE CUOTA 2 DE 6', NULL, 'Cruz Verde', 'confirmed', 'brand-alias', NULL),
    (15, 'WEBPAY PLUS LIBRERIA EL SOL', 'webpay', 'Libreria el SOL', 'suggested', 'residual-text', NULL),
    (16, 'PAGO ONLINE', NULL, NULL, NULL, NULL, 'bank-placeholder'),
    (17, 'SEGURO DE VIDA POLIZA 889', NULL, 'Seguro de Vida Poliza', 'suggested', 'residual-text', NULL),
    (18, 'FLOW*CLASES DE PIANO', 'flow', NULL, NULL, NULL, 'processor-hides-merchant'),
    (19, 'AVANCE EN EFECTIVO', NULL, NULL, NULL, NULL, 'nothing-left')
),
d AS (SELECT o.*, r.* FROM orders_f o JOIN readings r ON o.row_id % 20 = r.i)
"""
# Which built-in rule a description meets, its category and tag, the kind that it sets, and whether it looks at outflows only.
_RULED = """
ruled(i, rule, new_category, tag, sets, only_out, only_open) AS (VALUES
    (0, 'builtin.supermercado', 'alimentacion.supermercado', '', NULL, false, false), (1, 'builtin.electricidad', 'servicios.electricidad', '', NULL, false, false),
    (3, 'builtin.transferencia-propia', 'transferencias', '', 'internal_transfer', false, true), (4, 'builtin.comisiones', 'comisiones', '', 'fee', true, false),
    (5, 'builtin.intereses', 'deudas.intereses', '', 'interest', true, false), (10, 'builtin.sueldo', 'ingresos.sueldo', '', 'income', false, false), (11, 'builtin.giro-efectivo', NULL, 'efectivo', NULL, false, false),
    (12, 'builtin.impuestos', 'impuestos', '', 'tax', true, false), (13, 'builtin.suscripciones', 'suscripciones', 'suscripcion', NULL, false, false), (14, 'builtin.farmacia', 'salud.farmacia', '', NULL, false, false),
    (17, 'builtin.seguros', 'seguros', '', NULL, false, false), (19, 'builtin.giro-efectivo', NULL, 'efectivo', NULL, false, false)
),
q AS (
    SELECT d.*, row_id % 7 = 0 AS sure, rule IS NOT NULL AND (direction = 'out' OR NOT only_out) AND (row_id % 7 <> 0 OR NOT only_open) AS hit, rule, new_category, tag, sets,
        CASE WHEN direction = 'out' THEN CASE d.i WHEN 4 THEN 'maintenance' WHEN 5 THEN 'late_interest' WHEN 12 THEN 'credit_tax' END END AS cost
    FROM d LEFT JOIN ruled USING (i)
)
"""

_LINES = """
o AS (
    SELECT *, o_orderkey AS k, o_custkey % 3 AS layout, o_orderstatus = 'O' AS incoming, o_totalprice::DECIMAL(22,2) AS money, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS n
    FROM orders
),
s AS (
    SELECT *, CASE WHEN k % 19 = 0 THEN 'skipped' WHEN k % 11 = 0 AND k % 17 = 0 THEN 'skipped' WHEN k % 11 = 0 OR k % 17 = 0 OR k % 13 = 0 OR layout = 0 AND k % 23 = 0 THEN 'failed' ELSE 'mapped' END AS status,
        CASE WHEN incoming THEN money ELSE -money END AS signed, k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0 AS good,
        ['banco-chile.cuenta-corriente', 'banco-falabella.cmr', 'banco-falabella.cuenta'][layout + 1] AS parser,
        CASE WHEN layout = 1 AND k % 5 = 0 OR k % 20 = 14 THEN '2/6' WHEN layout = 1 AND k % 20 = 13 THEN '2/12' ELSE '' END AS plan
    FROM o
),
t AS (SELECT *, 1000 + sum(CASE WHEN good THEN signed ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY n) AS balance FROM s)
"""

_PAIRED = """
e AS (
    SELECT event_id, user_id, ts::DATE AS date, round(value, 2) AS v, event_type IN ('purchase', 'error') AS is_out, event_id % 3 AS words, user_id || ':' || event_id AS leg FROM events
),
p0 AS MATERIALIZED (
    SELECT o.leg AS o_leg, i.leg AS i_leg, abs(date_diff('day', o.date, i.date)) AS gap, 0 IN (o.words, i.words) AS own, 1 IN (o.words, i.words) AS third, {rank} AS rank
    FROM e o JOIN e i ON o.is_out AND NOT i.is_out AND o.v = i.v AND abs(date_diff('day', o.date, i.date)) <= 5 AND {where}
)"""


def _rounds(where: str, rank: str, rounds: int = 12) -> str:
    """Rounds of unique mutual bests: m1, m2, ... are settled, p1, p2, ... are left; the last round settles nothing more."""
    parts = [_PAIRED.format(where=where, rank=rank)]
    for k in range(rounds):
        best = lambda leg: f"min((-rank, gap)) OVER (PARTITION BY {leg})"
        parts.append(
            f"""b{k} AS MATERIALIZED (SELECT *, (-rank, gap) = {best("o_leg")} AS o_best, (-rank, gap) = {best("i_leg")} AS i_best FROM p{k}),
m{k + 1} AS MATERIALIZED (
    SELECT o_leg, i_leg, gap, own, third, rank
    FROM (SELECT *, count(*) FILTER (o_best) OVER (PARTITION BY o_leg) AS o_n, count(*) FILTER (i_best) OVER (PARTITION BY i_leg) AS i_n FROM b{k}) WHERE o_best AND i_best AND o_n = 1 AND i_n = 1
),
p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} WHERE o_leg NOT IN (SELECT o_leg FROM m{k + 1}) AND i_leg NOT IN (SELECT i_leg FROM m{k + 1}))"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM m{k + 1}" for k in range(rounds))
    return ",\n".join([*parts, f"settled AS ({union}), open_pairs AS (SELECT * FROM p{rounds})"])


_TRANSFERS = _rounds("o.user_id <> i.user_id", "CASE WHEN 0 IN (o.words, i.words) THEN 2 WHEN 1 IN (o.words, i.words) THEN 1 ELSE 0 END")
_CARDS = _rounds("o.words = 2 AND o.user_id % 2 = 1 AND i.user_id % 2 = 0", "0")

_PLANS = """
c AS (
    SELECT 'S' || l_suppkey AS merchant, (floor(l_quantity / 25 + 1) * 1000)::BIGINT AS amount, l_shipdate::DATE AS date, l_linenumber AS current, printf('%012d-%d', l_orderkey, l_linenumber) AS fingerprint FROM lineitem
),
keyed AS (SELECT *, sha256(concat_ws(chr(31), 'installment-plan', 'banco-chile', merchant, '9', round(ln(amount * 100) * 100)::INT, 'CLP')) AS plan_key FROM c),
numbered AS (SELECT *, row_number() OVER (PARTITION BY plan_key ORDER BY date, fingerprint, current) AS rn FROM keyed),
folded AS (
    SELECT plan_key, rn, 0 AS run, [current] AS seen FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.plan_key, n.rn, f.run + list_contains(f.seen, n.current)::INT, CASE WHEN list_contains(f.seen, n.current) THEN [n.current] ELSE list_append(f.seen, n.current) END
    FROM folded f JOIN numbered n ON n.plan_key = f.plan_key AND n.rn = f.rn + 1
),
g AS (
    SELECT plan_key, run, min_by(merchant, rn) AS merchant, min_by(amount, rn) AS amount, min_by(date, rn) AS first, list_sort(list(DISTINCT current)) AS seen, max(current) AS hi, min(current) AS lo, bool_or(current > 2) AS sure
    FROM numbered JOIN folded USING (plan_key, rn) GROUP BY ALL
),
plans AS (
    SELECT plan_key || CASE WHEN run = 0 THEN '' ELSE '-' || run END AS plan_id, merchant, amount, seen, hi, lo, sure, greatest(0, 9 - hi) AS remaining, (first + to_months((1 - lo)::INT))::DATE AS start_date FROM g
)
"""

_CHANGES = """
k AS (
    SELECT *, CASE WHEN lag(month) OVER w = strftime(strptime(month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m') THEN lag(net_spending) OVER w END AS ps,
        CASE WHEN lag(month) OVER w = strftime(strptime(month || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m') THEN lag(net_cash_flow) OVER w END AS pf
    FROM s WINDOW w AS (PARTITION BY currency ORDER BY month)
),
x AS (
    SELECT *, CASE WHEN ps <> 0 THEN (net_spending::DOUBLE - ps::DOUBLE) / abs(ps::DOUBLE) END AS cs, CASE WHEN pf <> 0 THEN (net_cash_flow::DOUBLE - pf::DOUBLE) / abs(pf::DOUBLE) END AS cf,
        CASE WHEN income > 0 THEN fixed_expenses::DOUBLE / income::DOUBLE END AS fx FROM k
),
flow AS (
    SELECT currency, month, 1 AS ord, 'net-negative' AS id, 'attention' AS severity, (net_spending - income)::DOUBLE AS value FROM x WHERE net_cash_flow < 0
    UNION ALL SELECT currency, month, 1, 'net-healthy', 'positive', savings_rate FROM x WHERE net_cash_flow >= 0 AND savings_rate >= 0.2
    UNION ALL SELECT currency, month, 2, 'expenses-change', CASE WHEN cs > 0 THEN 'attention' ELSE 'positive' END, cs FROM x WHERE abs(cs) >= 0.15 AND abs(net_spending - ps) >= 10000
    UNION ALL SELECT currency, month, 3, 'net-declining', 'attention', cf FROM x WHERE net_cash_flow < pf AND abs(cf) >= 0.15
    UNION ALL SELECT currency, month, 4, 'fixed-share-high', 'attention', fx FROM x WHERE fx >= 0.5
),
ct AS (
    SELECT currency, month, coalesce(category, 'sin-categoria') AS category, coalesce(sum(m) FILTER (kind <> 'refund'), 0) - coalesce(sum(m) FILTER (kind = 'refund'), 0) AS amount
    FROM f WHERE (direction = 'out' AND kind IN ('expense', 'credit_card_purchase', 'fee', 'tax', 'interest')) OR kind = 'refund' AND category IS NOT NULL GROUP BY ALL
),
cr AS (SELECT *, row_number() OVER (PARTITION BY currency, month ORDER BY amount DESC, category) AS rank FROM ct),
cc AS (
    SELECT a.currency, a.month, a.category, a.rank, a.amount, b.amount AS before, CASE WHEN b.amount <> 0 THEN (a.amount::DOUBLE - b.amount::DOUBLE) / abs(b.amount::DOUBLE) END AS value
    FROM cr a JOIN ct b ON a.currency = b.currency AND a.category = b.category AND a.month = strftime(strptime(b.month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') WHERE a.rank <= 8
),
cn AS (SELECT *, row_number() OVER (PARTITION BY currency, month ORDER BY rank) AS n FROM cc WHERE abs(value) >= 0.15 AND abs(amount - before) >= 10000),
mt AS (
    SELECT currency, month, merchant, sum(m) AS amount FROM f
    WHERE direction = 'out' AND kind IN ('expense', 'credit_card_purchase', 'fee', 'tax', 'interest') AND coalesce(cost_confidence, '') <> 'confirmed' AND merchant <> '' GROUP BY ALL
),
mm AS (SELECT currency, month, max(amount) AS top, count(*) AS n FROM mt GROUP BY ALL)
"""

_NAMES = "file_hash, parser"
ORACLES = {
    "attribution": f"WITH {_FACTS}, {_READINGS} SELECT description, any_value(processor_id) AS processor_id, any_value(merchant_name) AS merchant_name, any_value(merchant_confidence) AS merchant_confidence, any_value(merchant_source) AS merchant_source, any_value(unresolved) AS unresolved, count(*) AS n FROM d GROUP BY description",
    "kind_defaults": f"""WITH {_FACTS}, {_READINGS}, k AS (SELECT *, kind = 'credit_card_purchase' AS is_card FROM d)
        SELECT description, is_card, direction,
            CASE WHEN i = 19 THEN CASE WHEN is_card THEN 'cash_advance' WHEN direction = 'in' THEN 'unknown' ELSE 'expense' END WHEN is_card THEN 'credit_card_purchase' WHEN direction = 'in' THEN 'income' WHEN i = 9 THEN 'credit_card_payment' ELSE 'expense' END AS default_kind,
            CASE WHEN i = 19 AND is_card OR i = 9 AND NOT is_card AND direction = 'out' THEN 'confirmed' WHEN i = 19 AND direction = 'in' THEN 'unknown' ELSE 'suggested' END AS default_confidence, count(*) AS n
        FROM k GROUP BY ALL""",
    "rule_outcomes": f"""WITH {_FACTS}, {_READINGS}, {_RULED}
        SELECT row_id, merchant_name AS merchant, CASE WHEN hit THEN new_category END AS category, CASE WHEN hit AND sets IS NOT NULL AND NOT sure THEN sets ELSE kind END AS kind,
            CASE WHEN sure THEN 'confirmed' WHEN hit AND sets = 'internal_transfer' THEN 'suggested' WHEN hit AND sets IS NOT NULL THEN 'confirmed' ELSE 'suggested' END AS kind_confidence,
            CASE WHEN hit THEN tag ELSE '' END AS tags, CASE WHEN hit THEN rule ELSE '' END AS applied_rules, cost AS cost_kind, CASE WHEN cost IS NOT NULL THEN 'confirmed' END AS cost_confidence
        FROM q""",
    "installment_plans": f"""WITH RECURSIVE {_PLANS}
        SELECT plan_id, merchant, 'x' AS description, 'banco-chile' AS institution, 'CLP' AS currency, (amount * 9)::DOUBLE AS original_amount, amount::DOUBLE AS installment_amount, 9::BIGINT AS total_installments, hi::BIGINT AS current_installment,
            remaining::BIGINT AS remaining_installments, (amount * remaining)::DOUBLE AS remaining_amount, start_date, (start_date + INTERVAL 8 MONTH)::DATE AS estimated_end_date, array_to_string(seen, ',') AS observed_installments,
            len(seen) <> hi - lo + 1 AS has_gaps, CASE WHEN sure THEN 'confirmed' ELSE 'suggested' END AS confidence FROM plans""",
    "installment_outlook": f"""WITH RECURSIVE {_PLANS}, due AS (SELECT plan_id, amount, strftime(start_date + to_months((hi + i - 1)::INT), '%Y-%m') AS month FROM plans, unnest(range(1, remaining + 1)) t(i))
        SELECT 'CLP' AS currency, month, sum(amount)::DOUBLE AS amount, count(DISTINCT plan_id) AS plans FROM due WHERE month BETWEEN '1998-01' AND '1998-12' GROUP BY month""",
    "transfer_matches": f"""WITH {_TRANSFERS}
        SELECT o_leg, i_leg, gap AS gap_days, CASE WHEN NOT third AND own AND gap <= 2 THEN 'confirmed' ELSE 'suggested' END AS confidence,
            concat_ws('; ', CASE WHEN gap = 0 THEN 'Mismo día' ELSE gap || ' día(s) de diferencia' END, 'mismo monto en cuentas distintas', CASE WHEN own OR third THEN 'la glosa menciona una transferencia' END,
                CASE WHEN own THEN 'la glosa indica cuenta propia' END, CASE WHEN third THEN 'pero la glosa menciona a un tercero, así que no se confirma sola' END) || '.' AS reason
        FROM settled""",
    "ambiguous_transfers": f"""WITH RECURSIVE {_TRANSFERS}, near AS MATERIALIZED (SELECT o_leg AS a, i_leg AS b FROM open_pairs UNION SELECT i_leg, o_leg FROM open_pairs),
        reach(leg, other) AS (SELECT a, a FROM near UNION SELECT r.leg, n.b FROM reach r JOIN near n ON n.a = r.other)
        SELECT leg, min(other) AS knot FROM reach GROUP BY leg""",
    "transfer_summary": f"""WITH {_TRANSFERS}, legs AS (SELECT o_leg AS leg FROM settled UNION ALL SELECT i_leg FROM settled),
        x AS (SELECT e.*, strftime(date, '%Y-%m') AS month, v::DECIMAL(22,2) AS m, e.leg IN (SELECT leg FROM legs) AS moved, words = 2 AND user_id % 2 = 1 AND is_out AS paid FROM e),
        y AS (
            SELECT 'CLP' AS currency, month, count(*) AS transaction_count, coalesce(sum(m) FILTER (NOT moved AND NOT is_out), 0)::DOUBLE AS income, coalesce(sum(m) FILTER (NOT moved AND NOT paid AND is_out), 0)::DOUBLE AS spent,
                coalesce(sum(m) FILTER (moved AND is_out), 0)::DOUBLE AS internal_transfers, coalesce(sum(m) FILTER (NOT moved AND paid), 0)::DOUBLE AS card_payments FROM x GROUP BY month
        )
        SELECT currency, month, transaction_count, income, 0::DOUBLE AS refunds, spent AS gross_spending, spent AS consumption_spending, 0::DOUBLE AS fixed_expenses, spent AS variable_expenses, internal_transfers, card_payments,
            spent AS net_spending, income AS cash_inflows, income - spent AS net_cash_flow, CASE WHEN income > 0 THEN (income - spent) / income END AS savings_rate FROM y""",
    "card_payments": f"""WITH {_CARDS}, rivals AS (SELECT o_leg, count(*) AS n FROM open_pairs GROUP BY o_leg)
        SELECT o_leg AS payment, i_leg AS credit, 'confirmed' AS confidence, 'paired' AS reason, 0::BIGINT AS rivals FROM settled
        UNION ALL SELECT leg, NULL, 'suggested', CASE WHEN n > 0 THEN 'equal-rivals' ELSE 'statement-missing' END, coalesce(n, 0) FROM e LEFT JOIN rivals ON leg = rivals.o_leg
            WHERE is_out AND words = 2 AND user_id % 2 = 1 AND leg NOT IN (SELECT o_leg FROM settled)
        UNION ALL SELECT leg, NULL, 'suggested', 'charge-missing', 0 FROM e WHERE NOT is_out AND words = 2 AND user_id % 2 = 0 AND leg NOT IN (SELECT i_leg FROM p0)""",
    "month_insights": f"""WITH {_FACTS}, {_SUMMARY}, {_CHANGES}
        SELECT * FROM flow
        UNION ALL SELECT currency, month, n + 4, 'category-change:' || category, CASE WHEN value > 0 THEN 'attention' ELSE 'positive' END, value FROM cn WHERE n <= 4
        UNION ALL SELECT currency, month, 30, 'merchant-concentration', 'neutral', top::DOUBLE / net_spending::DOUBLE FROM mm JOIN s USING (currency, month) WHERE n >= 3 AND net_spending > 0 AND top::DOUBLE / net_spending::DOUBLE >= 0.2""",
    "legacy_conflicts": f"""WITH {_FACTS}, {_KEYED}, {_VERDICTS}, c AS (SELECT r % 10 AS file, max_by(activity, r) AS first FROM old WHERE r % 10 IN (2, 5) GROUP BY file),
        w AS (SELECT v.*, first, first IS NOT NULL AND reason_code NOT IN ('exact-fingerprint', 'host-modified') AS conflict FROM v LEFT JOIN c ON v.row_id % 10 = file)
        SELECT row_id, CASE WHEN conflict THEN 'probable' WHEN reason_code = 'exact-fingerprint' THEN 'exact' WHEN reason_code = 'new' THEN 'none' ELSE 'probable' END AS verdict, CASE WHEN conflict THEN 'legacy-source-conflict' ELSE reason_code END AS reason_code,
            CASE WHEN conflict THEN first WHEN reason_code IN ('exact-fingerprint', 'host-modified') THEN h WHEN reason_code = 'similar' THEN n END AS existing_activity_id, CASE WHEN NOT conflict AND reason_code = 'similar' THEN s END AS score
        FROM w""",
    "date_shapes": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 NOT IN (3, 4) THEN d END AS date, o_orderkey % 6 = 5 AND day(d) <= 12 AND day(d) <> month(d) AS ambiguous,
        CASE o_orderkey % 6 WHEN 3 THEN 'invalid-calendar-date' WHEN 4 THEN 'unknown-month-name' END AS error FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""",
    "import_breakdown": f"""WITH {_FACTS}, {_KEYED}, {_VERDICTS},
        b AS (SELECT row_id, currency, verdict, row_id % 13 = 0 AS conflict, row_id % 11 = 0 AS ignored, CASE WHEN row_id % 7 = 0 AND NOT (row_id % 2 = 0 AND row_id % 13 = 0) THEN row_id % 2 = 0 ELSE row_id % 11 <> 0 AND verdict = 'none' END AS chosen FROM verdicts),
        buckets AS (SELECT currency, CASE WHEN chosen AND NOT conflict THEN 'selected' WHEN verdict IN ('exact', 'probable') THEN verdict WHEN ignored THEN 'rule' ELSE 'user' END AS bucket FROM b),
        c AS (SELECT currency, count(*) // 3 AS created FROM orders_f WHERE row_id % 5 <> 0 GROUP BY currency),
        g AS (SELECT currency, count(*) AS detected, count(*) FILTER (bucket = 'selected') AS selected, count(*) FILTER (bucket = 'exact') AS skipped_exact, count(*) FILTER (bucket = 'probable') AS skipped_probable, count(*) FILTER (bucket = 'rule') AS skipped_by_rule, count(*) FILTER (bucket = 'user') AS skipped_by_user FROM buckets GROUP BY currency)
        SELECT g.*, least(coalesce(created, 0), selected)::BIGINT AS created, selected - least(coalesce(created, 0), selected)::BIGINT AS failed FROM g LEFT JOIN c USING (currency)""",
    "activity_types": f"""WITH {_FACTS}, t AS (
            SELECT direction, account_id % 2 = 0 AS on_card, CASE row_id % 9 WHEN 0 THEN 'interest' WHEN 1 THEN 'tax' WHEN 2 THEN 'internal_transfer' WHEN 3 THEN 'unknown' ELSE kind END AS kind FROM f
        ), types(kind, direction, cash, cash_other, card, card_other) AS (VALUES
            ('income', 'in', 'DEPOSIT', false, 'CREDIT', true), ('expense', 'out', 'WITHDRAWAL', false, 'WITHDRAWAL', false), ('credit_card_purchase', 'out', 'WITHDRAWAL', false, 'WITHDRAWAL', false), ('cash_advance', 'out', 'WITHDRAWAL', false, 'WITHDRAWAL', false),
            ('fee', 'out', 'FEE', false, 'FEE', false), ('refund', 'in', 'CREDIT', false, 'CREDIT', false), ('interest', 'in', 'INTEREST', false, 'CREDIT', true), ('interest', 'out', 'FEE', false, 'FEE', false), ('tax', 'in', 'CREDIT', true, 'CREDIT', true), ('tax', 'out', 'TAX', false, 'FEE', true),
            ('internal_transfer', 'in', 'TRANSFER_IN', false, 'TRANSFER_IN', false), ('internal_transfer', 'out', 'TRANSFER_OUT', false, 'WITHDRAWAL', true), ('unknown', 'in', 'UNKNOWN', false, 'CREDIT', true), ('unknown', 'out', 'UNKNOWN', false, 'WITHDRAWAL', true))
        SELECT kind, direction, on_card, CASE WHEN on_card THEN card ELSE cash END AS activity_type, CASE WHEN on_card THEN card_other ELSE cash_other END AS substituted, count(*) AS n FROM t LEFT JOIN types USING (kind, direction) GROUP BY ALL""",
    "monthly_charges": """WITH m AS (SELECT DISTINCT l_suppkey AS k, date_trunc('month', l_shipdate)::DATE AS month FROM lineitem),
        d AS (SELECT k, month + (k % 5)::INT AS date, 1000 + CASE k % 3 WHEN 0 THEN 100 WHEN 1 THEN 300 ELSE 900 END * (month(month) % 2) AS amount FROM m),
        gaps AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY k ORDER BY date), date) AS gap FROM d),
        g AS (SELECT k, count(*) AS n, min(gap) AS lo, max(gap) AS hi, quantile_disc(gap, 0.5) AS mid, quantile_disc(amount, 0.5) AS typical, min(amount) AS least, max(amount) AS most, min(date) AS first_date, max(date) AS last_date FROM gaps GROUP BY k),
        h AS (SELECT *, greatest(most - typical, typical - least) AS off FROM g), r AS (SELECT *, lo >= 24 AND hi <= 38 AND off * 10000 <= typical * 1500 AS regular FROM h)
        SELECT 'PROVEEDOR ' || k AS merchant_key, 'CLP' AS currency, typical::DOUBLE AS typical_amount, n AS occurrences, n AS charge_count, mid::BIGINT AS median_interval_days, lo::BIGINT AS min_interval_days, hi::BIGINT AS max_interval_days, off::DOUBLE / typical::DOUBLE AS amount_spread,
            first_date, last_date, CASE WHEN k % 2 = 0 THEN 'pac' END AS mandate, CASE WHEN regular AND k % 2 = 0 AND n >= 3 THEN 'likely' ELSE 'possible' END AS confidence
        FROM r WHERE n >= CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END AND lo >= 20 AND hi <= 45 AND off * 10000 <= typical * 4000 AND (n >= 3 OR regular)""",
    "parser_ranking": """WITH known(layout, parser, institution, score, rank, reasons) AS (VALUES
            (0, 'banco-chile.cuenta-corriente', 'banco-chile', 1.0, 1, 'marker,header,columns,account'), (0, 'banco-falabella.cuenta', 'banco-falabella', 0.75, 2, 'vocabulary,header,columns,account'),
            (0, 'generico.cuenta', 'generico', 0.75, 3, 'vocabulary,header,columns,account'), (0, 'banco-estado.cuenta', 'banco-estado', 0.65, 4, 'header,columns,account'), (0, 'banco-chile.tarjeta', 'banco-chile', 0.35, 5, 'marker,header,columns,account'),
            (1, 'banco-falabella.cmr', 'banco-falabella', 0.95, 1, 'marker,header,columns'), (1, 'generico.tarjeta', 'generico', 0.65, 2, 'vocabulary,header,columns'),
            (2, 'banco-falabella.cuenta', 'banco-falabella', 0.45, 1, 'vocabulary,header'), (2, 'generico.cuenta', 'generico', 0.45, 2, 'vocabulary,header'))
        SELECT o_custkey::VARCHAR AS file_hash, parser, institution, score::DOUBLE AS score, rank::BIGINT AS rank, reasons FROM (SELECT DISTINCT o_custkey FROM orders) JOIN known ON o_custkey % 3 = layout""",
    "statement_rows": f"""WITH {_LINES}
        SELECT o_custkey::VARCHAR AS file_hash, parser, (n + 3)::BIGINT AS source_line, status,
            CASE WHEN status = 'failed' THEN CASE WHEN k % 11 = 0 THEN 'missing-date' WHEN k % 17 = 0 THEN 'missing-description' WHEN k % 13 = 0 THEN 'unreadable-amount' ELSE 'debit-and-credit' END END AS failure,
            CASE WHEN status = 'mapped' THEN d END AS date, CASE WHEN status = 'mapped' THEN signed::DOUBLE END AS amount, CASE WHEN status = 'mapped' THEN CASE WHEN incoming THEN 'in' ELSE 'out' END END AS direction,
            CASE WHEN status = 'mapped' AND layout = 0 THEN balance::DOUBLE END AS balance_after, CASE WHEN status = 'mapped' AND layout = 1 THEN '4412' END AS card_last4, CASE WHEN status = 'mapped' THEN plan ELSE '' END AS plan,
            CASE WHEN status = 'mapped' THEN concat_ws(',', CASE WHEN plan = '2/12' THEN 'ambiguous-installment' END, CASE WHEN plan <> '' THEN 'ambiguous-installment-amount' END, CASE WHEN layout = 1 AND incoming AND k % 20 <> 9 THEN 'ambiguous-card-credit' END) END AS warnings
        FROM t""",
    "statement_balances": f"""WITH {_LINES},
        g AS (
            SELECT o_custkey, layout, parser, count(*) AS data_rows, count(*) FILTER (status = 'mapped') AS mapped, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, min(d) FILTER (status = 'mapped') AS lo,
                max(d) FILTER (status = 'mapped') AS hi, count(DISTINCT d) FILTER (status = 'mapped') AS days, max_by(balance, n) FILTER (status = 'mapped') AS last, count(*) FILTER (k % 11 <> 0 AND day(d) > 12) AS proofs, count(*) FILTER (k % 11 <> 0 AND day(d) <= 12 AND day(d) <> month(d)) AS odd
            FROM t GROUP BY ALL
        ), h AS (SELECT *, mapped = 1 OR days > 1 AS ordered FROM g)
        SELECT o_custkey::VARCHAR AS file_hash, parser, CASE WHEN layout = 0 THEN printf('00-%09d', o_custkey) END AS account_number, 'CLP' AS currency, CASE WHEN layout = 1 THEN DATE '1992-01-01' ELSE lo END AS period_from,
            CASE WHEN layout = 1 THEN DATE '1998-12-31' ELSE hi END AS period_to, CASE WHEN layout = 0 AND failed = 0 AND ordered THEN 1000.0::DOUBLE END AS opening, CASE WHEN layout = 0 AND failed = 0 AND ordered THEN 'derived' END AS opening_source,
            CASE WHEN layout = 0 AND failed = 0 AND ordered THEN last::DOUBLE END AS closing, data_rows, mapped, skipped, failed, CASE WHEN layout = 0 AND days > 1 THEN true END AS balance_reconciles, mapped > 0 AND failed = 0 AS ok,
            concat_ws(',', CASE WHEN proofs = 0 AND odd > 0 THEN 'warning:ambiguous-date-order' END, CASE WHEN failed > 0 THEN 'error:row-parse-failed' END, 'warning:profile-unverified', CASE WHEN mapped = 0 THEN 'error:no-transactions' END,
                CASE WHEN mapped > 1 AND days = 1 THEN 'info:balance-order-ambiguous' END) AS issues
        FROM h""",
    "card_facts": """WITH c AS (SELECT c_custkey AS k, abs(c_acctbal::DECIMAL(22,2))::DOUBLE AS m FROM customer),
        d(fact, lo, hi) AS (VALUES ('minimum_payment', NULL, NULL), ('billed_amount', NULL, NULL), ('foreign_debt', NULL, NULL), ('credit_limit', NULL, NULL), ('available_credit', NULL, NULL), ('due_date', NULL, NULL), ('billing_period', DATE '2024-01-01', DATE '2024-01-31'))
        SELECT k::VARCHAR AS file_hash, fact, CASE fact WHEN 'credit_limit' THEN 1000000 WHEN 'available_credit' THEN -m WHEN 'due_date' THEN NULL WHEN 'billing_period' THEN NULL ELSE m END::DOUBLE AS amount,
            CASE WHEN fact IN ('due_date', 'billing_period') THEN NULL WHEN fact = 'foreign_debt' THEN 'USD' ELSE 'CLP' END AS currency, CASE WHEN fact = 'due_date' THEN (DATE '2024-01-01' + (k % 300)::INT)::DATE ELSE lo END AS from_date, hi AS to_date
        FROM c, d WHERE fact <> 'minimum_payment' OR k % 5 <> 0 OR m = 1""",
    "amount_readings": """WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(22,2) AS m, floor(l_extendedprice::DECIMAL(22,2))::BIGINT AS w FROM lineitem), u AS (SELECT *, l_linenumber >= 7 AND w BETWEEN 1000 AND 999999 AS odd FROM t)
        SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber IN (1, 4, 5) THEN m::DOUBLE WHEN l_linenumber IN (2, 3) THEN -m::DOUBLE WHEN l_linenumber = 6 THEN -w::DOUBLE WHEN odd THEN (w::DECIMAL(22,3) / 1000)::DOUBLE ELSE w::DOUBLE END AS amount,
            CASE WHEN l_linenumber <= 5 THEN 2 WHEN odd THEN 3 ELSE 0 END::BIGINT AS scale, odd AS ambiguous, CASE WHEN l_linenumber = 4 THEN 'credit' END AS explicit_sign, NULL::VARCHAR AS error FROM u""",
    "file_movements": """WITH n AS (SELECT *, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) - 1 AS n, o_custkey % 6 AS form, o_totalprice::DECIMAL(22,2) AS money FROM orders)
        SELECT '/files/' || o_custkey || '-' || n // 500 || CASE WHEN form < 2 THEN '.csv' WHEN form < 4 THEN '.txt' ELSE '.xlsx' END AS path, CASE WHEN form < 2 THEN 'csv' WHEN form < 4 THEN 'delimited' ELSE 'xlsx' END AS kind,
            (form = 5)::BIGINT AS sheet_index, n % 500 + 3 AS row_index, CASE WHEN form < 4 THEN strftime(day, '%d/%m/%Y') ELSE strftime(day, '%Y-%m-%d') END AS date,
            'CAFÉ "EL NIÑO"; S.A., UNO|DOS' || chr(9) || 'TRES' || chr(10) || 'AÑO € ' || o_orderkey AS description,
            CASE WHEN form < 4 THEN translate(format('{:,.2f}', money::DOUBLE), ',.', '.,') WHEN money = floor(money) THEN money::BIGINT::VARCHAR ELSE money::DOUBLE::VARCHAR END AS amount,
            CASE WHEN form < 4 THEN '' ELSE 'grouped-decimal' END AS amount_format FROM n""",
    "ledger_readings": """WITH k AS (SELECT o_orderkey AS k, o_custkey % 2 = 0 AS card, CASE WHEN (o_orderkey // 12) % 2 = 0 THEN 'out' ELSE 'in' END AS way, o_totalprice::DECIMAL(22,2) AS money, o_orderkey % 5 + 1 AS v, o_orderkey % 7 AS e,
            ['income', 'expense', 'credit_card_purchase', 'cash_advance', 'internal_transfer', 'investment', 'credit_card_payment', 'refund', 'fee', 'tax', 'interest', 'unknown'][o_orderkey % 12 + 1] AS kind FROM orders),
        n AS (SELECT *, CASE WHEN kind = 'income' THEN 'DEPOSIT' WHEN kind IN ('expense', 'credit_card_purchase', 'cash_advance') THEN 'WITHDRAWAL' WHEN kind IN ('internal_transfer', 'investment', 'credit_card_payment') THEN CASE way WHEN 'out' THEN 'TRANSFER_OUT' ELSE 'TRANSFER_IN' END
            WHEN kind = 'refund' THEN 'CREDIT' WHEN kind = 'fee' THEN 'FEE' WHEN kind = 'tax' THEN 'TAX' WHEN kind = 'interest' THEN CASE way WHEN 'out' THEN 'FEE' ELSE 'INTEREST' END ELSE 'UNKNOWN' END AS plain_type FROM k),
        w AS (SELECT *, CASE plain_type WHEN 'DEPOSIT' THEN 'in' WHEN 'TRANSFER_IN' THEN 'in' WHEN 'CREDIT' THEN 'in' WHEN 'INTEREST' THEN 'in' WHEN 'UNKNOWN' THEN way ELSE 'out' END <> way AS wrong, CASE way WHEN 'out' THEN 'WITHDRAWAL' ELSE 'CREDIT' END AS nearest FROM n),
        c AS (SELECT *, CASE WHEN wrong THEN nearest WHEN plain_type IN ('WITHDRAWAL', 'TRANSFER_IN', 'CREDIT', 'FEE') THEN plain_type WHEN plain_type = 'INTEREST' THEN 'CREDIT' WHEN plain_type = 'TAX' THEN 'FEE' ELSE nearest END AS on_card FROM w),
        t AS (SELECT *, CASE WHEN card THEN on_card WHEN wrong THEN nearest ELSE plain_type END AS first_type FROM c),
        s AS (SELECT *, CASE e WHEN 0 THEN 'CREDIT' WHEN 2 THEN 'INTEREST' ELSE first_type END AS type, first_type <> plain_type AS subst,
            CASE WHEN e = 0 THEN CASE k % 3 WHEN 1 THEN 'BONUS' WHEN 2 THEN 'REBATE' END WHEN first_type <> plain_type THEN NULL WHEN kind = 'refund' THEN 'REFUND' WHEN kind = 'interest' AND first_type = 'FEE' THEN 'INTEREST_CHARGE' END AS subtype FROM t),
        u AS (SELECT *, CASE WHEN v >= 3 THEN type = first_type AND e <> 1 ELSE e > 2 END AS is_current FROM s),
        d AS (SELECT *, CASE WHEN type = 'INTEREST' AND card THEN coalesce(CASE WHEN is_current AND v >= 2 THEN way END, 'out') WHEN type IN ('DEPOSIT', 'TRANSFER_IN', 'CREDIT', 'INTEREST') THEN 'in' WHEN type = 'UNKNOWN' THEN CASE WHEN v >= 2 THEN way ELSE 'in' END ELSE 'out' END AS direction FROM u),
        -- what was written is known from version 2; before it the direction read now stands for it
        f AS (SELECT *, CASE WHEN kind = 'income' THEN type = 'DEPOSIT' WHEN kind IN ('expense', 'credit_card_purchase', 'cash_advance') THEN type = 'WITHDRAWAL' WHEN kind IN ('internal_transfer', 'investment', 'credit_card_payment') THEN type = CASE CASE WHEN v >= 2 THEN way ELSE direction END WHEN 'out' THEN 'TRANSFER_OUT' ELSE 'TRANSFER_IN' END
            WHEN kind = 'refund' THEN type = 'CREDIT' WHEN kind = 'fee' THEN type = 'FEE' WHEN kind = 'tax' THEN type = 'TAX' WHEN kind = 'interest' THEN type = CASE CASE WHEN v >= 2 THEN way ELSE direction END WHEN 'out' THEN 'FEE' ELSE 'INTEREST' END ELSE type = 'UNKNOWN' END AS natural_still,
            CASE WHEN v >= 2 THEN way ELSE direction END AS written FROM d),
        g AS (SELECT *, CASE WHEN kind = 'income' THEN CASE written WHEN 'in' THEN 'CREDIT' ELSE 'WITHDRAWAL' END WHEN kind IN ('expense', 'credit_card_purchase', 'cash_advance') THEN CASE written WHEN 'in' THEN 'CREDIT' ELSE 'WITHDRAWAL' END
            WHEN kind IN ('internal_transfer', 'investment', 'credit_card_payment') THEN CASE written WHEN 'in' THEN 'TRANSFER_IN' ELSE 'WITHDRAWAL' END WHEN kind = 'refund' THEN CASE written WHEN 'in' THEN 'CREDIT' ELSE 'WITHDRAWAL' END
            WHEN kind IN ('fee', 'tax') THEN CASE written WHEN 'in' THEN 'CREDIT' ELSE 'FEE' END WHEN kind = 'interest' THEN CASE written WHEN 'in' THEN 'CREDIT' ELSE 'FEE' END ELSE CASE written WHEN 'in' THEN 'CREDIT' ELSE 'WITHDRAWAL' END END AS forced FROM f),
        h AS (SELECT *, CASE WHEN is_current AND (natural_still OR subst AND forced = type) THEN kind ELSE CASE type WHEN 'DEPOSIT' THEN 'income' WHEN 'WITHDRAWAL' THEN 'expense' WHEN 'TRANSFER_IN' THEN 'internal_transfer' WHEN 'TRANSFER_OUT' THEN 'internal_transfer'
            WHEN 'CREDIT' THEN CASE WHEN card THEN 'refund' WHEN subtype = 'BONUS' THEN 'income' WHEN subtype IN ('REFUND', 'REBATE') THEN 'refund' ELSE 'unknown' END WHEN 'FEE' THEN CASE WHEN subtype = 'INTEREST_CHARGE' THEN 'interest' ELSE 'fee' END WHEN 'TAX' THEN 'tax' WHEN 'INTEREST' THEN 'interest' ELSE 'unknown' END END AS read_kind FROM g)
        SELECT k AS o_orderkey, direction, read_kind AS kind, CASE WHEN is_current AND read_kind = kind AND v >= 5 THEN 'confirmed' ELSE 'suggested' END AS kind_confidence, (CASE direction WHEN 'out' THEN -money ELSE money END)::DOUBLE AS amount,
            CASE WHEN is_current THEN 'c' END AS category, CASE WHEN is_current AND v >= 4 AND k % 2 = 0 THEN 'commission' END AS cost_kind, CASE WHEN is_current AND k % 4 = 0 THEN 6 END::BIGINT AS installment_total, CASE WHEN e = 1 THEN 'OTRA' ELSE 'GLOSA' END AS description, is_current FROM h""",
    "import_batches": """WITH n AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders)
        SELECT batch, count(*) FILTER (k % 3 <> 0 AND k % 50 <> 0) AS created, count(*) FILTER (k % 3 = 0 AND k % 50 <> 0) AS skipped, count(*) FILTER (k % 50 = 0) AS failed, CASE WHEN count(*) FILTER (k % 50 = 0) > 0 THEN 'no-amount' ELSE '' END AS reasons FROM n GROUP BY batch""",
    "dashboard": f"""WITH {_FACTS}, {_SUMMARY},
        spine AS (SELECT currency, strftime(DATE '1998-11-01' - to_months(k::INT), '%Y-%m') AS month FROM (SELECT DISTINCT currency FROM f WHERE month BETWEEN '1997-11' AND '1998-11'), range(13) t(k)),
        c AS (SELECT currency, month, coalesce(category, 'sin-categoria') AS category, coalesce(sum(m) FILTER (kind <> 'refund'), 0) - coalesce(sum(m) FILTER (kind = 'refund'), 0) AS amount FROM f WHERE {_SPEND} OR kind = 'refund' AND category IS NOT NULL GROUP BY ALL),
        ct AS (SELECT currency, month, count(*) AS categories, first(category ORDER BY amount DESC, category) AS top_category, max(amount) AS top_category_amount FROM c WHERE amount > 0 GROUP BY ALL),
        mt AS (SELECT currency, month, first(merchant ORDER BY amount DESC, merchant) AS top_merchant, max(amount) AS top_merchant_amount FROM (SELECT currency, month, merchant, sum(m) AS amount FROM f WHERE {_SPEND} AND NOT {_ISSUER} AND merchant <> '' GROUP BY ALL) WHERE amount > 0 GROUP BY ALL),
        it AS (SELECT currency, month, sum(m) AS issuer_charges FROM f WHERE {_SPEND} AND {_ISSUER} GROUP BY ALL),
        j AS (SELECT currency, month, coalesce(transaction_count, 0) AS transaction_count, savings_rate, {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in ("income", "refunds", "gross_spending", "fixed_expenses", "variable_expenses", "net_spending", "net_cash_flow", "issuer_charges"))},
            top_category, top_category_amount::DOUBLE AS top_category_amount, top_merchant, top_merchant_amount::DOUBLE AS top_merchant_amount, coalesce(categories, 0) AS categories, coalesce(net_spending, 0) AS exact
            FROM spine LEFT JOIN s USING (currency, month) LEFT JOIN ct USING (currency, month) LEFT JOIN mt USING (currency, month) LEFT JOIN it USING (currency, month))
        SELECT * EXCLUDE (exact), (exact - lag(exact) OVER (PARTITION BY currency ORDER BY month))::DOUBLE AS net_spending_change FROM j""",
    "calibration_profile": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS d, CASE o_orderstatus WHEN 'O' THEN 1 ELSE -1 END * CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice::DECIMAL(22,2) ELSE floor(o_totalprice)::DECIMAL(22,2) END AS ok FROM orders),
        l AS (SELECT *, 'p' || c % 3 AS parser, (CASE WHEN k % 31 = 0 THEN -ok WHEN k % 37 = 0 THEN ok::DECIMAL(22,4) * 0.01::DECIMAL(3,2) WHEN k % 41 = 0 THEN ok * 1000 WHEN k % 43 = 0 THEN ok + 1 ELSE ok END)::DECIMAL(28,6) AS a,
            CASE c % 4 WHEN 0 THEN -row_number() OVER (PARTITION BY c ORDER BY d, k) WHEN 1 THEN k ELSE row_number() OVER (PARTITION BY c ORDER BY d, k) END AS line FROM o),
        b AS (SELECT *, CASE WHEN k % 3 <> 0 THEN sum(ok) OVER w END AS bal, sum(a) OVER w AS run, date_diff('day', lag(d) OVER w, d) AS step FROM l WINDOW w AS (PARTITION BY c ORDER BY line)),
        x AS (SELECT parser, bal - lag(bal) OVER w AS e, run - lag(run) OVER w AS s FROM b WHERE bal IS NOT NULL WINDOW w AS (PARTITION BY c ORDER BY line)),
        r AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE abs(e::DOUBLE / s::DOUBLE) END AS q FROM x WHERE e IS NOT NULL),
        m AS (SELECT parser, CASE WHEN e = s THEN 'none' WHEN s <> 0 AND e = -s THEN 'sign' WHEN abs(q - 100) < 1 OR abs(q - 0.01) < 0.0001 THEN 'scale-100' WHEN abs(q - 1000) < 10 OR abs(q - 0.001) < 0.00001 THEN 'scale-1000' ELSE 'other' END AS value FROM r),
        f AS (SELECT parser, c, coalesce(min(step), 0) AS lo, coalesce(max(step), 0) AS hi FROM b GROUP BY ALL),
        t AS (SELECT parser, rtrim(split_part(a::VARCHAR, '.', 2), '0') AS tail, a, k FROM l)
        SELECT parser, 'scale' AS measure, len(tail)::VARCHAR AS value, count(*) AS n FROM t GROUP BY ALL
        UNION ALL SELECT parser, 'flow', CASE WHEN a > 0 THEN 'in' WHEN a < 0 THEN 'out' ELSE 'zero' END, count(*) FROM t GROUP BY ALL
        UNION ALL SELECT parser, 'kind', CASE WHEN k % 5 = 0 THEN 'unknown' WHEN a > 0 THEN 'income' ELSE 'expense' END, count(*) FROM t GROUP BY ALL
        UNION ALL SELECT parser, 'confidence', CASE WHEN k % 5 = 0 THEN 'unresolved' WHEN k % 7 = 0 THEN 'confirmed' ELSE 'suggested' END, count(*) FROM t GROUP BY ALL
        UNION ALL SELECT parser, 'order', CASE WHEN lo = 0 AND hi = 0 THEN 'single-day' WHEN lo >= 0 THEN 'ascending' WHEN hi <= 0 THEN 'descending' ELSE 'mixed' END, count(*) FROM f GROUP BY ALL
        UNION ALL SELECT parser, 'mismatch', value, count(*) FROM m GROUP BY ALL""",
}

_PROFILES = ", ".join(f"({i}, {p.is_card})" for i, p in enumerate(PROFILES))
ORACLES |= {
    "charge_insights": f"""WITH RECURSIVE plans AS ({ORACLES["installment_plans"]}), due AS ({ORACLES["installment_outlook"]}), charges AS ({ORACLES["monthly_charges"]}),
        d AS (SELECT currency, sum(amount) FILTER (month <= '1998-03') AS three, sum(amount) FILTER (month = '1998-01') AS now FROM due GROUP BY currency),
        c AS (SELECT currency, count(*) FILTER (confidence = 'likely') AS likely, sum(typical_amount) FILTER (confidence = 'likely') AS monthly, count(mandate) AS mandated FROM charges GROUP BY currency),
        r AS (SELECT currency, 10 AS ord, 'installments-next-three' AS id, 'neutral' AS severity, three AS value FROM d WHERE three <> 0 UNION ALL SELECT currency, 11, 'installments-this-month', 'neutral', now FROM d WHERE now IS NOT NULL
            UNION ALL SELECT currency, 12, 'installments-uncertain', 'attention', count(*) FROM plans WHERE remaining_installments > 0 AND (confidence <> 'confirmed' OR has_gaps) GROUP BY currency
            UNION ALL SELECT currency, 20, 'recurring-count', 'neutral', likely FROM c WHERE likely > 0 UNION ALL SELECT currency, 21, 'recurring-monthly', 'neutral', monthly FROM c WHERE likely > 0 UNION ALL SELECT currency, 22, 'recurring-mandates', 'neutral', mandated FROM c WHERE mandated > 0)
        SELECT currency, '1998-01' AS month, ord::BIGINT AS ord, id, severity, value::DOUBLE AS value FROM r""",
    "import_readiness": f"""WITH p(i, card) AS (VALUES {_PROFILES}),
        k AS (SELECT c_custkey AS k, card, c_custkey % 3 = 0 AS on_card, c_custkey % 5 = 0 AND c_custkey % 10 <> 0 AS other, CASE WHEN c_custkey % 6 <> 0 THEN '00' || lpad(c_custkey::VARCHAR, 9, '0') ELSE '' END AS theirs,
            CASE c_custkey % 4 WHEN 0 THEN lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN lpad((c_custkey + 1)::VARCHAR, 9, '0') WHEN 2 THEN '123' ELSE '' END AS mine FROM customer JOIN p ON i = c_custkey % {len(PROFILES)}),
        n AS (SELECT *, least(len(mine), len(theirs), 8) AS n FROM k), s AS (SELECT *, n >= 4 AS known, right(mine, n) = right(theirs, n) AS same, card <> on_card AS odd FROM n),
        v AS (SELECT *, CASE WHEN other OR known AND NOT same THEN 'blocked' WHEN odd THEN 'warning' WHEN known THEN 'confirmed' ELSE 'unknown' END AS verdict FROM s),
        b AS (SELECT *, concat_ws(',', CASE WHEN verdict = 'blocked' THEN 'account-mismatch' END, CASE WHEN k % 11 = 0 THEN 'statement-invalid' END, CASE WHEN k % 13 = 0 THEN 'duplicate-check-unavailable' END) AS blockers FROM v)
        SELECT k::VARCHAR AS file_hash, verdict AS account_verdict, concat_ws(',', CASE WHEN other THEN 'currency' END, CASE WHEN known AND NOT same THEN 'number-differs' END, CASE WHEN known AND same THEN 'number-equal' END, CASE WHEN odd THEN 'product' END) AS reasons,
            blockers, blockers = '' AS can_import FROM b""",
    "page_sections": """WITH n AS (SELECT o_custkey AS c, o_orderkey AS k, floor(o_totalprice) >= 1000 AS grouped, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) - 1 AS n FROM orders),
        g AS (SELECT c, k, n, grouped, CASE WHEN n >= 5 THEN ['COMPRAS NACIONALES', 'CARGOS COMISIONES IMPUESTOS Y ABONOS', 'COMPRAS INTERNACIONALES'][(n // 5) % 3 + 1] END AS section FROM n),
        f AS (SELECT c AS file, section, count(*) FILTER (grouped AND k % 9 <> 0) AS rows FROM g GROUP BY ALL),
        e AS (SELECT DISTINCT o_custkey AS file, section FROM orders, (VALUES ('COMPRAS NACIONALES'), ('COMPRAS INTERNACIONALES'), ('OTROS'), ('CARGOS COMISIONES IMPUESTOS Y ABONOS'), (NULL)) v(section))
        SELECT e.file, e.section, e.section IS NOT NULL AND f.file IS NOT NULL AS found, coalesce(rows, 0) AS rows FROM e LEFT JOIN f ON e.file = f.file AND e.section IS NOT DISTINCT FROM f.section""",
    "stamped_payments": f"""WITH RECURSIVE paid AS ({ORACLES["card_payments"]}), pairs AS (SELECT payment AS a, credit AS b FROM paid WHERE credit IS NOT NULL UNION ALL SELECT credit, payment FROM paid WHERE credit IS NOT NULL)
        SELECT split_part(a, ':', 2)::BIGINT AS row_id, 'credit_card_payment' AS kind, 'confirmed' AS kind_confidence, split_part(b, ':', 2) AS counterpart_fingerprint FROM pairs""",
}
