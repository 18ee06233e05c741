"""Fixed domain values. They must equal the published filings' codes and names."""

from __future__ import annotations

# --- fixed values: balance-sheet accounts ---
EQUITY = "6.0.0.00.00-2"
TOTAL_ASSETS = "1.0.0.00.00-7"
REVENUE = "7.0.0.00.00-9"
EXPENSES = "8.0.0.00.00-6"
CREDIT = "1.6.0.00.00-1"
DEPOSITS = "4.1.0.00.00-7"

KPI_ACCOUNTS = {
    "Patrimônio Líquido": EQUITY,
    "Ativo Total": TOTAL_ASSETS,
    "Operações de Crédito": CREDIT,
    "Depósitos": DEPOSITS,
    "Resultado Líquido": REVENUE,
}

# --- fixed values: reports of the quarterly filing ---
SUMMARY, INCOME, CAPITAL = "1", "4", "5"
REPORT_NAMES = {
    SUMMARY: "Resumo",
    INCOME: "Demonstração de Resultado",
    CAPITAL: "Informações de Capital",
}
PRUDENTIAL_TYPE = 1009
INDIVIDUAL_TYPE = 1006
FIRST_DATA_INDICATOR = 100
GROUP_CODE_BASE = 1_000_000_000

# --- fixed values: line names read by the top-50 indicators ---
LINE_ASSETS = "Ativo Total"
LINE_CREDIT = "Carteira de Crédito"
LINE_FUNDING = "Captações"
LINE_PROFIT = "Lucro Líquido"

# --- fixed values: income lines whose names changed between years ---
INCOME_RENAMES = {
    "Resultado antes da Tributação, Lucro e Participação":
        "Resultado antes da Tributação e Participações",
    "Participação nos Lucros": "Participações no Lucro",
}

# --- fixed values: display order of the summarised income statement ---
INCOME_ORDER = {
    "7.1": 10,
    "8.1": 20,
    "RESULTADO BRUTO": 30,
    "7.3": 40,
    "7.5": 50,
    "7.7": 60,
    "8.3": 70,
    "8.5": 80,
    "8.7": 90,
    "8.9": 100,
    "RESULTADO OPERACIONAL": 110,
    "7.9": 120,
    "RESULTADO ANTES TRIBUTAÇÃO": 130,
}
INCOME_ORDER_OTHER = 999

# --- fixed values: (row label, row name) of the three income subtotals ---
SUBTOTAL_GROSS = ("RESULTADO BRUTO", "= Resultado Bruto de Intermediação Financeira")
SUBTOTAL_OPERATING = ("RESULTADO OPERACIONAL", "= Resultado Operacional")
SUBTOTAL_PRETAX = ("RESULTADO ANTES TRIBUTAÇÃO", "= Resultado antes da Tributação")

# --- fixed values: name suffixes, regulatory first, then legal form ---
REGULATORY_SUFFIXES = (" - PRUDENCIAL", " - FINANCEIRO")
LEGAL_SUFFIXES = (" S.A.", " S/A", " LTDA.", " LTDA")

# --- fixed values: lines stored as fractions and shown as percentages ---
PERCENT_LINE_PATTERN = "(?iu)(índice|indice|razão|razao|irrbb|adicional de capital)"

# --- fixed values: Portuguese month abbreviations ---
MONTH_NAMES = (
    "Jan", "Fev", "Mar", "Abr", "Mai", "Jun",
    "Jul", "Ago", "Set", "Out", "Nov", "Dez",
)

# --- fixed values: group codes of the default peer group ---
PEER_GROUPS = {
    "PEERS": (
        1000085317, 1000084693, 1000080996, 1000084844, 1000084686, 1000084813,
        1000084820, 1000087384, 1000085771, 1000087157, 1000080336, 1000083694,
        1000080271, 1000080422, 1000081744, 1000080178, 1000080123, 1000080312,
        1000080099, 1000080075, 1000080185, 1000080329, 1000084909,
    ),
}
