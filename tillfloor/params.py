"""Parameters of the sales and production layers.

Everything a calculation depends on is a field here; nothing is read from a
file at run time and no constant hides inside an operator.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Product classification, equipment, standards, reason codes and
# plant parameters. They define the published results and must not change.

EXCLUDED_PRODUCTS = ("CAFE OU EAU", "FORMULE SANDWICH", "COUPE")

CATEGORY_PRODUCTS = {
    "viennoiserie": (
        "CROISSANT", "PAIN AU CHOCOLAT", "PAIN AUX RAISINS", "CROISSANT AMANDES",
        "PAIN CHOCO AMANDES", "KOUIGN AMANN", "CHAUSSON AUX POMMES",
    ),
    "patisserie": ("COOKIE", "TARTELETTE", "ECLAIR"),
    "sandwich": ("SANDWICH COMPLET",),
}
DEFAULT_CATEGORY = "bread"
ASSEMBLED_CATEGORY = "sandwich"
CATCHALL_PREFIX = "DIVERS "

# machine_id, machine_name, machine_type, install_year, capacity_units,
# full_load_reference, handling_minutes, base_failure_rate_per_hr
MACHINES = (
    (1, "Deck Oven Line", "deck_oven", 2012,
     "3 decks (120 x 160 cm); a batch takes the decks it needs",
     "30 baguettes per deck = 90 per full load", 6.0, 0.045),
    (2, "Rack Oven Line", "rack_oven", 2019,
     "18 trays (600 x 400 mm); a batch takes the trays it needs",
     "16 croissants per tray (4 x 4, 70 g) = 288 per full rack", 2.0, 0.020),
    (3, "Assembly Bench", "manual_assembly", 2019,
     "manual station, no oven",
     "60 seconds per sandwich = 60 units/hr", 0.0, 0.005),
)

# product_name, machine_id, units_per_full_load, bake_minutes, assembly_seconds
OPERATING_STANDARDS = (
    ("TRADITIONAL BAGUETTE", 1, 90, 24.0, None),
    ("BAGUETTE", 1, 90, 24.0, None),
    ("BANETTE", 1, 90, 24.0, None),
    ("CEREAL BAGUETTE", 1, 90, 26.0, None),
    ("FICELLE", 1, 117, 22.0, None),
    ("BANETTINE", 1, 108, 22.0, None),
    ("BOULE 200G", 1, 54, 28.0, None),
    ("BOULE 400G", 1, 36, 35.0, None),
    ("PAIN", 1, 45, 32.0, None),
    ("PAIN BANETTE", 1, 45, 32.0, None),
    ("QUIM BREAD", 1, 45, 32.0, None),
    ("CAMPAGNE", 1, 27, 42.0, None),
    ("COMPLET", 1, 27, 42.0, None),
    ("MOISSON", 1, 27, 42.0, None),
    ("SPECIAL BREAD", 1, 27, 40.0, None),
    ("VIK BREAD", 1, 27, 40.0, None),
    ("CROISSANT", 2, 288, 18.0, None),
    ("PAIN AU CHOCOLAT", 2, 216, 19.0, None),
    ("PAIN AUX RAISINS", 2, 216, 20.0, None),
    ("CROISSANT AMANDES", 2, 216, 20.0, None),
    ("PAIN CHOCO AMANDES", 2, 216, 20.0, None),
    ("KOUIGN AMANN", 2, 216, 24.0, None),
    ("CHAUSSON AUX POMMES", 2, 144, 22.0, None),
    ("COOKIE", 2, 432, 13.0, None),
    ("TARTELETTE", 2, 216, 20.0, None),
    ("ECLAIR", 2, 360, 29.0, None),
    ("SANDWICH COMPLET", 3, None, None, 60.0),
)

REASON_LABELS = {
    "01": "Changeover / SMED",
    "02": "Mechanical / Technical",
    "03": "Process / Materials",
    "04": "Personnel",
    "05": "Quality / Rejection",
    "06": "Micro-stop (never logged)",
    "98": "Uncategorised",
    "99": "Other",
}
MICRO_STOP_CODE = "06"
UNCATEGORISED_CODE = "98"
CATCHALL_CODE = "99"

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Published totals of the cleaned sales file.
EXPECTED_SALES_TOTALS = {"total_rows": 232_679, "products": 147, "total_revenue": 562_716.70}


@dataclass(frozen=True)
class Params:
    """Plant, cost and quality parameters (fixed values, see above)."""

    top_products: int = 30
    outlet_factor: int = 2
    planning_efficiency: float = 0.85
    deck_lots: int = 3
    rack_lots: int = 18
    shift_start_hour: int = 2
    stop_cap: float = 0.85
    achieved_rate: float = 0.88
    base_scrap_rate: float = 0.04
    changeover_minutes: float = 9.0
    logged_from_minutes: float = 3.0
    band_edges: tuple[float, float] = (10.0, 30.0)
    round_to_minutes: float = 5.0
    scrap_per_stop: float = 0.012
    scrap_cap: float = 0.30
    inspection_rate: float = 0.25
    sample_divisor: int = 20
    sample_min: int = 5
    sample_max: int = 50
    fail_scrap_rate: float = 0.07
    catchall_min_share: float = 0.15
    products_expected: int = 27
    machines_expected: int = 3
    # A weekday that trades on fewer dates than this share of the busiest
    # weekday's dates is mostly closed, so it is no genuine trading day.
    genuine_day_share: float = 0.8
    morning_hours: tuple[int, int] = (8, 12)
    summer_months: tuple[int, ...] = (7, 8)
    cost_ratio: dict[str, str] = field(default_factory=lambda: {
        "bread": "0.30", "viennoiserie": "0.36", "patisserie": "0.40", "sandwich": "0.45"})
    scrap_multiplier: dict[str, float] = field(default_factory=lambda: {
        "bread": 1.0, "viennoiserie": 1.2, "patisserie": 1.4, "sandwich": 0.8})
    category_machines: dict[str, int] = field(default_factory=lambda: {
        "bread": 1, "viennoiserie": 2, "patisserie": 2, "sandwich": 3})


PARAMS = Params()
