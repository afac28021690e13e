from anchorage.plans import cleaning, explain, models, money, portfolio, risk, survival  # noqa: F401
from anchorage.plans.catalog import ORACLES, QUERIES  # noqa: F401
