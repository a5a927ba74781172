"""Fixed values that results depend on: labels, calendars, thresholds, patterns."""

# Thresholds of the outcome flags (open-to-close unless said otherwise).
DUMP = -0.05
FALL_3 = -0.03
BIG_FALL = -0.10
BIG_DUMP = -0.15
PUMP = 0.05
UP_10 = 0.10
SQUEEZE = 0.20          # high / open - 1
SWING = -0.15           # next open to the fifth close

# Market clock in US Eastern minutes of the day, left-closed.
PRE_MARKET_FROM = 240
OPEN_FROM = 570
AFTER_HOURS_FROM = 960
AFTER_HOURS_TO = 1200

# Exchange holidays.
HOLIDAYS = [
    "2025-01-01", "2025-01-09", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26",
    "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19",
    "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18",
    "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
]

# Filing categories and their labels.
CATEGORY_LABELS = {
    "offering": "Offering",
    "atm": "At-the-market program",
    "toxic_financing": "Toxic financing",
    "unregistered_sale": "Unregistered sale",
    "registration": "Registration",
    "resale": "Resale registration",
    "effective": "Declared effective",
    "delisting_notice": "Deficiency / delisting notice",
    "going_concern": "Going-concern doubt",
    "late_filing": "Late filing",
    "reverse_split": "Reverse split",
    "charter_amendment": "Charter amendment",
    "insider_sale_notice": "Form 144 sale notice",
    "insider": "Insider filing",
    "material_agreement": "Material agreement",
    "other": "Other",
}
SUPPLY_CATEGORIES = ["offering", "atm", "toxic_financing", "unregistered_sale"]

# Borrow status labels.
STATUS_LABELS = {
    "ETB": "Easy to borrow",
    "HTB": "Hard to borrow",
    "NONE": "No borrow",
    "UNKNOWN": "Borrow unknown",
}

# Countries and addresses counted as Asia-linked.
ASIA = [
    "China", "Hong Kong", "Singapore", "Malaysia", "Taiwan", "Japan", "Cayman Islands",
    "British Virgin Islands", "Macau", "Thailand", "Vietnam", "Indonesia", "Philippines",
]

# Flag patterns.
RED_FLAG = r"^(OFFERING|ATM|DILUTION|PUMP|GAP|RUN)\b"
SOLID_FLAG = r"^(NO BORROW|HALTED)$"

# Report-time codes of the calendar.
REPORT_TIMES = {
    "time-pre-market": "before the open",
    "pre-market": "before the open",
    "time-after-hours": "after the close",
    "after-hours": "after the close",
    "time-not-supplied": "time n/a",
    "not-supplied": "time n/a",
}

# Signal families, in display order.
FAMILIES = ["dilution", "exhaustion", "decay", "flow", "street", "news"]

# Board bands, position sizes, planner grid.
BOARD_BANDS = [(1, 1), (2, 10), (11, 25), (26, 50), (51, 100)]
SIZES = [10000, 30000, 50000, 100000, 500000, 1000000]
PLAN_TOTALS = [10000, 25000, 50000, 100000, 250000, 500000, 1000000]
PLAN_K = [1, 3, 5, 10]

# Caps on the estimated spread by 20-day dollar volume.
SPREAD_TIERS = [(250e3, 0.06), (1e6, 0.03), (5e6, 0.0145), (20e6, 0.009)]
SPREAD_TOP_TIER = 0.0055

# Impact factor and capacity rules.
IMPACT_Y = 0.7
MAX_PARTICIPATION = 0.05
MAX_IMPACT = 0.005
BOARD_MIN_USD = 30000.0
ONE_MIN_USD = 100000.0
MIN_DOLLAR_VOLUME = 300e3

# Sort keys of the board, with the column and whether it sorts ascending at first.
BOARD_SORTS: dict[str, tuple[str, bool]] = {
    "rank": ("rank", True),
    "prob": ("prob_dump", False),
    "edge": ("liq_edge", False),          # shown as -edge ascending
    "lift": ("lift", False),
    "gap": ("gap_pct", False),
    "fee": ("fee_rate", True),
    "sq": ("squeeze_danger", True),
    "size": ("cost_at_size", True),
    "symbol": ("symbol", True),
}

# Sort keys of the lookup table, with the column shown and whether it sorts ascending at first.
LOOKUP_SORTS = {
    "symbol": ("symbol", True), "price": ("price", False), "market_cap": ("market_cap", False), "prob": ("prob_dump", False),
    "prob_squeeze": ("prob_squeeze", False), "prob_swing": ("prob_swing", False), "skew": ("skew", False),
    "fee_rate": ("fee_rate", True), "squeeze_danger": ("squeeze_danger", True), "capacity": ("capacity", False),
}
