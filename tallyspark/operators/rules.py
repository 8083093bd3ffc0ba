"""The rule engine: ordered rules, each of which sees what those before it did, as Column expressions.

Rules are compiled in order of priority and id. Rows carry kind, kind_confidence, merchant, category, tags, applied_rules, ignored
and whether a rule has ended the row; each rule is one projection over these, so the plan grows linearly in the number of rules.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.patterns import runs_away
from tallyspark.functions.text import fold_case
from tallyspark.operators.enrich import with_attribution, with_financial_cost
from tallyspark.operators.kinds import KINDS
from tallyspark.session import once_per

TEXT_FIELDS = ("description", "merchant", "account", "institution", "kind", "direction", "category", "operation_type", "product")
NUMBER_FIELDS = ("amount", "abs_amount")
TEXT_OPERATORS = ("contains", "not_contains", "equals", "not_equals", "starts_with", "ends_with", "matches")
NUMBER_OPERATORS = ("gt", "gte", "lt", "lte", "between")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Action:
    type: str
    value: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    priority: int
    conditions: tuple[Condition, ...]
    actions: tuple[Action, ...]
    match: str = "any"
    stop: bool = False
    origin: str = "builtin"
    enabled: bool = True
    name: str = ""
    tags: tuple[str, ...] = field(default=())


def ordered(rules: list[Rule]) -> list[Rule]:
    return sorted((r for r in rules if r.enabled), key=lambda r: (r.priority, r.id))


def valid_pattern(pattern: str) -> bool:
    """Whether a pattern compiles, has at most 200 characters, and can't run away: see ``patterns.runs_away``."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return len(pattern) <= 200 and not runs_away(pattern)


def problems(rule: Rule) -> list[str]:
    """Why a rule of a user can't be taken; empty if it can."""
    out = []
    if not rule.conditions:
        out.append("no conditions")
    for c in rule.conditions:
        if c.field in NUMBER_FIELDS and c.operator not in NUMBER_OPERATORS or c.field in TEXT_FIELDS and c.operator not in TEXT_OPERATORS or c.field not in (*TEXT_FIELDS, *NUMBER_FIELDS):
            out.append(f"{c.operator} does not apply to {c.field}")
        elif c.operator == "matches" and not valid_pattern(str(c.value)):
            out.append(f"bad pattern: {c.value}")
        elif c.operator == "between" and not (isinstance(c.value, (list, tuple)) and len(c.value) == 2):
            out.append("between needs two numbers")
    if not rule.actions:
        out.append("no actions")
    for a in rule.actions:
        if a.type not in ("set_category", "set_merchant", "add_tag") and rule.origin == "user":
            out.append(f"not for users: {a.type}")
        if a.type == "set_kind" and a.value not in KINDS:
            out.append(f"unknown kind: {a.value}")
    return out


def effective(builtin: list[Rule], user: list[Rule], disabled: set[str]) -> list[Rule]:
    """Built-in rules that are not disabled, with users' rules, of priority 500, in place of those with the same id."""
    by_id = {r.id: r for r in builtin if r.id not in disabled}
    for r in user:
        by_id[r.id] = Rule(r.id, 500, r.conditions, r.actions, r.match, r.stop, "user", r.enabled, r.name)
    return ordered(list(by_id.values()))


_COLUMNS = {"description": "normalized_description", "account": "account_id"}


def _holds(c: Condition) -> Column:
    if c.operator in NUMBER_OPERATORS:
        if c.field not in NUMBER_FIELDS:
            return F.lit(False)
        x = F.col("amount").cast("double")
        x = F.abs(x) if c.field == "abs_amount" else x
        if c.operator == "between":
            return x.between(float(c.value[0]), float(c.value[1])) if isinstance(c.value, (list, tuple)) and len(c.value) == 2 else F.lit(False)
        try:
            v = float(c.value)
        except (TypeError, ValueError):
            return F.lit(False)
        return {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[c.operator]
    if c.field not in TEXT_FIELDS:
        return F.lit(False)
    raw = F.col(_COLUMNS.get(c.field, c.field))
    # Without a product nothing is said about it, not even that it differs.
    text = raw if c.field == "product" else F.coalesce(raw, F.lit(""))
    if c.operator == "matches":
        return F.coalesce(text.rlike(f"(?i){c.value}"), F.lit(False)) if valid_pattern(str(c.value)) else F.lit(False)
    # Descriptions come folded; merchants are folded once, and again by a rule that sets them.
    folded = {"description": F.coalesce(raw, F.lit("")), "merchant": F.col("__merchant")}
    a, b = folded[c.field] if c.field in folded else fold_case(text), F.lit(folded_text(str(c.value)))
    out = {"contains": a.contains(b), "equals": a == b, "starts_with": a.startswith(b), "ends_with": a.endswith(b)}[c.operator.removeprefix("not_")]
    return F.coalesce(~out if c.operator.startswith("not_") else out, F.lit(False))


def folded_text(text: str) -> str:
    """What fold_case makes of a text, for constants."""
    return "".join(x for x in unicodedata.normalize("NFD", text) if not 0x300 <= ord(x) <= 0x36F).upper()


def _matches(rule: Rule) -> Column:
    if not rule.conditions:
        return F.lit(False)
    out = _holds(rule.conditions[0])
    for c in rule.conditions[1:]:
        out = out & _holds(c) if rule.match == "all" else out | _holds(c)
    return out


def apply_rules(df: DataFrame, rules: list[Rule], attribute: bool = True) -> DataFrame:
    """Adds or overwrites merchant, category, kind, kind_confidence, tags, applied_rules, ignored and marked_transfer.

    A built-in rule can't change a kind that came confirmed, and one that marks transfers doesn't apply to such rows at all. Cash
    advances have no merchant in the end.
    """
    if attribute:
        df = with_attribution(df).withColumn("merchant", F.coalesce("merchant_name", "merchant")).withColumn("payment_processor", F.col("processor"))
    df = df.withColumns({"__open": F.col("kind_confidence") != "confirmed", "__live": F.lit(True), "applied_rules": F.array().cast("array<string>"), "ignored": F.lit(False), "marked_transfer": F.lit(False), "__merchant": F.coalesce(fold_case(F.col("merchant")), F.lit(""))})
    for rule in ordered(rules):
        may = F.col("__open") if rule.origin == "builtin" else F.lit(True)
        hit = F.col("__live") & _matches(rule)
        if any(a.type == "mark_transfer" for a in rule.actions):
            hit = hit & may
        df = df.withColumn("__hit", hit)
        on = F.col("__hit")
        new: dict[str, Column] = {"applied_rules": F.when(on, F.array_append("applied_rules", F.lit(rule.id))).otherwise(F.col("applied_rules"))}
        put = lambda name, value, when: F.when(when, value).otherwise(new.get(name, F.col(name)))  # noqa: B023, E731
        for a in rule.actions:
            if a.type in ("set_category", "set_merchant") and a.value:
                name = a.type.removeprefix("set_")
                new[name] = put(name, F.lit(a.value), on)
                if name == "merchant":
                    new["__merchant"] = put("__merchant", F.lit(folded_text(a.value)), on)
            elif a.type == "set_kind" and a.value in KINDS:
                new["kind"], new["kind_confidence"] = put("kind", F.lit(a.value), on & may), put("kind_confidence", F.lit("confirmed"), on & may)
            elif a.type == "add_tag" and a.value:
                new["tags"] = put("tags", F.array_union("tags", F.array(F.lit(a.value))), on)
            elif a.type == "mark_transfer":
                new["kind"], new["kind_confidence"] = put("kind", F.lit("internal_transfer"), on), put("kind_confidence", F.lit("suggested"), on)
                new["marked_transfer"] = put("marked_transfer", F.lit(True), on)
            elif a.type == "ignore":
                new["ignored"] = put("ignored", F.lit(True), on)
        if rule.stop:
            new["__live"] = F.col("__live") & ~on
        df = df.withColumns(new)
    advance = F.col("kind") == "cash_advance"
    return df.withColumn("merchant", F.when(~advance, F.col("merchant"))).drop("__open", "__live", "__hit", "__merchant")


def new_tags(before: Column, after: Column) -> Column:
    """Tags that were added."""
    return F.array_except(after, F.coalesce(before, F.array().cast("array<string>")))


#: The columns that rules read or change.
_READ = ("normalized_description", "description", "direction", "product", "kind", "kind_confidence", "merchant", "category", "tags", "account_id", "institution", "reference", "operation_type", "amount", "payment_processor")


def apply_once(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``apply_rules`` and financial costs, once for each combination of the columns that these rules read, joined back to the rows.

    The same results for less work wherever descriptions repeat. Rules on amounts or references see nearly as many combinations as
    rows; for these ``apply_rules`` does better. Not for streams."""
    fields = {c.field for r in rules for c in r.conditions}
    named = {_COLUMNS.get(f, f) for f in fields} | ({"amount"} if fields & set(NUMBER_FIELDS) else set())
    always = {"normalized_description", "direction", "kind", "kind_confidence", "merchant", "category", "tags"}
    keys = [c for c in _READ if c in df.columns and c in always | named]
    made = [c for c in ("kind", "kind_confidence", "merchant", "category", "tags") if c in keys]

    def work(few: DataFrame) -> DataFrame:
        before = few.withColumns({f"__was_{c}": F.col(c) for c in made})
        after = with_financial_cost(apply_rules(before, rules))
        return after.select(*(F.col(f"__was_{c}" if c in made else c).alias(c) for c in keys), *(F.col(c).alias(f"__now_{c}") for c in made), *(c for c in after.columns if c not in keys and not c.startswith("__was_")))

    out = once_per(df, keys, work)
    return out.withColumns({c: F.col(f"__now_{c}") for c in made}).drop(*(f"__now_{c}" for c in made))


def preview(df: DataFrame, before: list[Rule], after: list[Rule]) -> DataFrame:
    """How a change of rules would tell: rows, and how many each set applies to, change, and ignore."""
    keys = ["category", "merchant", "kind", "tags", "ignored"]
    a = apply_rules(df, before).select("fingerprint", F.struct("applied_rules", *keys).alias("a"))
    b = apply_rules(df, after).select("fingerprint", F.struct("applied_rules", *keys).alias("b"))
    seen = lambda x: F.struct(*(F.col(f"{x}.{k}") for k in keys))
    return a.join(b, "fingerprint").agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(F.size("b.applied_rules") > 0).alias("matched"),
        F.count_if(~seen("a").eqNullSafe(seen("b"))).alias("changed"),
        F.count_if("b.ignored").alias("ignored"),
    )


def _contains(*values: str) -> tuple[Condition, ...]:
    return tuple(Condition("description", "contains", v) for v in values)


def _words(*values: str) -> tuple[Condition, ...]:
    return tuple(Condition("description", "matches", rf"\b{v}\b") for v in values)


def _merchants(*values: str) -> tuple[Condition, ...]:
    return tuple(Condition("merchant", "equals", v) for v in values)


def _category(value: str) -> Action:
    return Action("set_category", value)


_OUT = Condition("direction", "equals", "out")
# The built-in rules.
BUILTIN = (
    Rule("builtin.pago-tarjeta", 10, (Condition("kind", "equals", "credit_card_payment"),), (_category("pago-tarjeta"),), stop=True),
    Rule("builtin.transferencia-propia", 20, _contains("CUENTA PROPIA", "ENTRE CUENTAS"), (Action("mark_transfer"), _category("transferencias")), stop=True),
    Rule("builtin.traspaso-cuenta", 21, (*_contains("TRASPASO"), Condition("product", "not_equals", "credit_card"), Condition("product", "not_equals", "credit_line")), (Action("mark_transfer"), _category("transferencias")), match="all", stop=True),
    Rule("builtin.comisiones", 30, (Condition("description", "matches", r"\b(?:COMISION(?:ES)?|(?:CARGO[\s./-]+POR[\s./-]+ADMINISTRACION)|(?:MANTENCION|MANTENIMIENTO)(?:[\s./-]+DE)?[\s./-]+(?:TARJETA|CUENTA|LINEA[\s./-]+DE[\s./-]+CREDITO))\b"), _OUT), (Action("set_kind", "fee"), _category("comisiones")), match="all"),
    Rule("builtin.intereses", 31, (Condition("description", "matches", r"\bINTERES(?:ES)?[\s./-]+(?:(?:POR[\s./-]+)?(?:MORA|SOBREGIRO|CUOTAS?)|MORATORIOS?|ROTATIVOS?|ADICIONALES?|REFUNDIDOS?|(?:POR[\s./-]+)?COMPRAS?[\s./-]+EN[\s./-]+CUOTAS?)\b"), _OUT), (Action("set_kind", "interest"), _category("deudas.intereses")), match="all"),
    Rule("builtin.impuestos", 32, (Condition("description", "matches", r"\b(?:IMPUESTOS?|IVA|TIMBRES[\s./-]+Y[\s./-]+ESTAMPILLAS|(?:IMPUESTO|LEY)(?:[\s./-]+DE)?[\s./-]+TIMBRES)\b"), _OUT), (Action("set_kind", "tax"), _category("impuestos")), match="all"),
    Rule("builtin.sueldo", 40, (*_contains("SUELDO", "REMUNERACION", "LIQUIDACION"), *_words("NOMINA")), (Action("set_kind", "income"), _category("ingresos.sueldo"))),
    Rule("builtin.supermercado", 50, _merchants("Lider", "Jumbo", "Santa Isabel", "Tottus", "Unimarc"), (_category("alimentacion.supermercado"),)),
    Rule("builtin.delivery", 51, _merchants("Rappi", "PedidosYa", "Uber Eats"), (_category("alimentacion.delivery"),)),
    Rule("builtin.transporte-apps", 52, _merchants("Uber", "Cabify", "DiDi"), (_category("transporte.apps"),)),
    Rule("builtin.transporte-publico", 53, (*_merchants("Metro de Santiago"), *_words("BIP"), *_contains("TRANSANTIAGO")), (_category("transporte.publico"),)),
    Rule("builtin.combustible", 54, (*_merchants("Copec", "Shell", "Petrobras"), *_contains("BENCINA")), (_category("transporte.combustible"),)),
    Rule("builtin.tag", 55, (*_contains("AUTOPISTA", "COSTANERA NORTE", "VESPUCIO"), *_words("TAG")), (_category("transporte.estacionamiento"),)),
    Rule("builtin.farmacia", 60, _merchants("Cruz Verde", "Salcobrand", "Farmacias Ahumada"), (_category("salud.farmacia"),)),
    Rule("builtin.prevision-salud", 61, (*_merchants("Salud"), *_contains("ISAPRE", "FONASA")), (_category("salud.prevision"),)),
    Rule("builtin.electricidad", 70, (*_merchants("Enel"), *_contains("CHILECTRA", "CGE")), (_category("servicios.electricidad"),)),
    Rule("builtin.agua", 71, (*_merchants("Aguas Andinas"), *_contains("ESVAL"), *_words("AGUAS")), (_category("servicios.agua"),)),
    Rule("builtin.gas", 72, (*_merchants("Gas", "Metrogas"), *_contains("LIPIGAS", "ABASTIBLE")), (_category("servicios.gas"),)),
    Rule("builtin.telecom", 73, _merchants("Entel", "Movistar", "Claro", "WOM", "VTR"), (_category("servicios.internet"),)),
    Rule("builtin.suscripciones", 80, _merchants("Netflix", "Spotify", "Disney+", "HBO Max", "Amazon Prime", "OpenAI", "Apple", "Google", "Microsoft"), (_category("suscripciones"), Action("add_tag", "suscripcion"))),
    Rule("builtin.retail", 90, _merchants("Falabella", "Paris", "Ripley", "Mercado Libre", "AliExpress", "Amazon"), (_category("compras"),)),
    Rule("builtin.hogar", 91, _merchants("Sodimac", "Easy"), (_category("compras"),)),
    Rule("builtin.seguros", 100, _contains("SEGURO", "POLIZA"), (_category("seguros"),)),
    Rule("builtin.giro-efectivo", 110, _contains("GIRO CAJERO", "RETIRO EFECTIVO", "AVANCE EN EFECTIVO"), (Action("add_tag", "efectivo"),)),
)
