"""What is known of the statements of each institution: declared once, used by expressions over all files.

All names, patterns, codes and texts below are fixed values, written whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: A row with one of these at its beginning is no movement.
IGNORED = (
    r"(?i)^SALDO\s+(ANTERIOR|INICIAL|FINAL|ACTUAL|DISPONIBLE|CONTABLE)",
    r"(?i)^TOTAL(ES)?\b",
    r"(?i)^SUBTOTAL",
    r"(?i)^RESUMEN\b",
    r"(?i)^MOVIMIENTOS?\s+(DEL|ENTRE)\b",
    r"(?i)^P[AÁ]GINA\s+\d+",
)
#: The least score of a parser that counts as a candidate, in hundredths.
FLOOR = 35


@dataclass(frozen=True)
class Profile:
    parser: str
    version: str
    institution: str
    label: str
    product: str = "checking"
    currency: str = "CLP"
    number_format: str = "es-CL"
    date_order: str = "DMY"
    #: signed, debit-positive or credit-positive: what a figure without any other mark means.
    amount_sign: str = "signed"
    #: Whether a running balance that is off is an error or a warning.
    balance_check: str = "advisory"
    verified: bool = False
    date_omits_year: bool = False
    ambiguous_is_error: bool = False
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    file_names: tuple[str, ...] = ()
    disqualifying: tuple[str, ...] = ()
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    signatures: tuple[tuple[str, ...], ...] = ()
    #: header, code, message
    unsupported: tuple[tuple[str, str, str], ...] = ()
    ignored: tuple[str, ...] = ()
    remaining_headers: tuple[str, ...] = ()
    #: (opening row, closing row, label of the date of issue)
    anchors: tuple[str, str, str] | None = None
    period: str | None = None
    #: Formats of columns of spreadsheets, where all their cells' shapes, or any of their texts, show it.
    formats: dict[str, str] = field(default_factory=dict)
    format_texts: dict[str, str] = field(default_factory=dict)
    format_shapes: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def is_card(self) -> bool:
        return self.product in ("credit_card", "credit_line")


PROFILES = (
    Profile(
        "banco-chile.cuenta-corriente", "0.2.0", "banco-chile", "Banco de Chile — cuenta corriente", date_omits_year=True,
        strong=(r"(?i)BANCO\s+DE\s+CHILE", r"(?i)\bBANCHILE\b", r"(?i)BANCO\s+EDWARDS"),
        weak=(r"(?i)CHEQUES?\s+Y\s+CARGOS", r"(?i)DEP[OÓ]SITOS?\s+Y\s+ABONOS", r"(?i)CANAL\s+O\s+SUCURSAL"),
        file_names=(r"(?i)cartola", r"(?i)movimientos"),
        anchors=(r"(?i)^SALDO\s+INICIAL", r"(?i)^SALDO\s+FINAL", r"(?i)FECHA\s+DE?\s*EMISI[OÓ]N[^\d]{0,20}(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}-\d{2}-\d{2})"),
        synonyms={
            "date": ("Fecha", "Fecha Transaccion"), "description": ("Descripcion", "Detalle", "Descripción"), "operation_type": ("Canal o Sucursal", "Canal", "Sucursal"),
            "debit": ("Cargo", "Cargos (CLP)", "Cargos (PESOS)", "Cheques y Cargos"), "credit": ("Abono", "Abonos (CLP)", "Abonos (PESOS)", "Depositos y Abonos"),
            "balance": ("Saldo", "Saldo (CLP)", "Saldo (PESOS)"), "reference": ("N Documento", "Nro Documento"),
        },
        ignored=(r"(?i)^SALDO\s+(INICIAL|FINAL)", r"(?i)^TOTAL"),
    ),
    Profile(
        "banco-chile.tarjeta", "0.2.0", "banco-chile", "Banco de Chile — tarjeta de crédito", product="credit_card", amount_sign="debit-positive", ambiguous_is_error=True,
        strong=(
            r"(?i)BANCO\s+DE\s+CHILE", r"(?i)\bBANCHILE\b",
            r"(?i)\A(?=[\s\S]*MOVIMIENTOS\s+(?:NACIONALES|INTERNACIONALES))(?=[\s\S]*(?:MOVIMIENTOS\s+FACTURADOS|MONTO\s+FACTURADO|PAGO\s+MINIMO|FECHA\s+DE\s+FACTURACION|PAGAR\s+HASTA))",
        ),
        weak=(r"(?i)TARJETA\s+DE\s+CR[EÉ]DITO", r"(?i)FACTURACI[OÓ]N", r"(?i)CUPO\s+(?:TOTAL|UTILIZADO)"),
        file_names=(r"(?i)tarjeta", r"(?i)estado.?cuenta"),
        disqualifying=(r"(?i)\bCMR\b", r"(?i)BANCO\s+FALABELLA", r"(?i)\bFALABELLA\b"),
        synonyms={
            "date": ("Fecha", "Fecha Compra", "Fecha Operacion"), "description": ("Descripcion", "Comercio", "Detalle"), "amount": ("Monto", "Monto Operacion", "Monto ($)"),
            "installment": ("Cuotas", "Cuota"), "card": ("Tarjeta", "N Tarjeta"),
        },
        signatures=(("Categoría", "Fecha", "Descripción", "País", "Monto Moneda Origen", "Monto (USD)"),),
        unsupported=(("Monto (USD)", "foreign-currency-unsupported", "Este archivo contiene movimientos internacionales facturados en USD, que todavía no se pueden importar dentro de una tarjeta cuya cuenta se modela en CLP."),),
        formats={"amount": "en-US"}, format_shapes={"amount": ("integer", "grouped-integer", "currency-integer")},
    ),
    Profile(
        "banco-estado.cuenta", "0.2.0", "banco-estado", "BancoEstado — CuentaRUT / cuenta corriente", date_omits_year=True, ambiguous_is_error=True,
        strong=(r"(?i)BANCO\s*ESTADO", r"(?i)BANCOESTADO", r"(?i)CUENTA\s*RUT", r"(?i)CUENTARUT"),
        weak=(r"(?i)CHEQUERA\s+ELECTR[OÓ]NICA", r"(?i)\bCAJA\s+VECINA\b", r"(?i)\bGIROS?\b"),
        file_names=(r"(?i)cartola", r"(?i)cuentarut", r"(?i)movimientos"),
        synonyms={
            "date": ("Fecha", "Fecha Transaccion", "Fecha Movimiento"), "description": ("Descripcion", "Descripción", "Detalle", "Glosa"), "debit": ("Cargo", "Cargos", "Giro", "Giros"),
            "credit": ("Abono", "Abonos", "Deposito", "Depositos"), "balance": ("Saldo",), "reference": ("N Documento", "Numero Documento", "Documento"), "operation_type": ("Canal", "Tipo Movimiento"),
        },
        period=r"(?i)\bFecha\s+Inicio\b[^\d]{0,20}(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}-\d{2}-\d{2})[^\d]{0,40}\bFecha\s+(?:T[eé]rmino|Final)\b[^\d]{0,20}(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{4}-\d{2}-\d{2})",
        ignored=(r"(?i)^SALDO\s+(INICIAL|FINAL|ANTERIOR)", r"(?i)^TOTAL"),
        formats={"debit": "en-US", "credit": "en-US"}, format_texts={"debit": r"^[+-]?\d{1,3}(?:,\d{3})+$", "credit": r"^[+-]?\d{1,3}(?:,\d{3})+$"},
    ),
    Profile(
        "banco-falabella.cmr", "0.2.0", "banco-falabella", "Banco Falabella / CMR — tarjeta", product="credit_card", amount_sign="debit-positive",
        strong=(r"(?i)\bCMR\b", r"(?i)FALABELLA"),
        weak=(r"(?i)CUOTAS?\s+SIN\s+INTER[EÉ]S", r"(?i)\bSEGURO\s+CMR\b", r"(?i)AVANCE\s+EN\s+EFECTIVO"),
        file_names=(r"(?i)cmr", r"(?i)falabella", r"(?i)estado.?cuenta"),
        synonyms={
            "date": ("Fecha", "Fecha Compra", "Fecha Transaccion"), "description": ("Descripcion", "Comercio", "Detalle Movimiento"), "amount": ("Monto", "Monto Operacion"), "installment_amount": ("Valor Cuota", "Monto Cuota"),
            "purchase_amount": ("Monto Total", "Monto Compra"), "installment": ("Cuotas", "Cuota", "N Cuotas"), "card": ("Tarjeta", "N Tarjeta"), "category": ("Rubro", "Categoria"),
        },
        signatures=(("FECHA", "DESCRIPCION", "TITULAR/ADICIONAL", "MONTO", "CUOTAS PENDIENTES", "VALOR CUOTA"),),
        remaining_headers=("CUOTAS PENDIENTES",),
        ignored=(r"(?i)^TOTAL", r"(?i)^CUPO", r"(?i)^PAGO\s+M[IÍ]NIMO"),
    ),
    Profile(
        "banco-falabella.cuenta", "0.1.0", "banco-falabella", "Banco Falabella — cuenta corriente",
        strong=(r"(?i)BANCO\s+FALABELLA",), weak=(r"(?i)CUENTA\s+CORRIENTE", r"(?i)\bCARGO\b", r"(?i)\bABONO\b"), file_names=(r"(?i)falabella", r"(?i)cartola"),
        synonyms={"debit": ("Cargo", "Cargos"), "credit": ("Abono", "Abonos")},
    ),
    Profile("generico.cuenta", "1.0.0", "generico", "Genérico (cuenta corriente / vista)", balance_check="authoritative", verified=True, weak=(r"(?i)\bCARGO\b", r"(?i)\bABONO\b", r"(?i)\bSALDO\b")),
    Profile("generico.tarjeta", "1.0.0", "generico", "Genérico (tarjeta de crédito)", product="credit_card", amount_sign="debit-positive", verified=True, weak=(r"(?i)\bCUOTA", r"(?i)\bTARJETA\b", r"(?i)\bFACTURACI[OÓ]N\b")),
)
INSTITUTIONS = {"banco-chile": "Banco de Chile", "banco-estado": "BancoEstado", "banco-falabella": "Banco Falabella / CMR", "generico": "Genérico"}
BY_PARSER = {p.parser: p for p in PROFILES}


def institutions() -> dict[str, tuple[str, list[Profile]]]:
    """Label and parsers of each institution, in order."""
    return {i: (label, [p for p in PROFILES if p.institution == i]) for i, label in INSTITUTIONS.items()}
