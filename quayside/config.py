"""Defaults of the tables that steer the operators. Every operator takes its table as an argument, so a user supplies their own."""

from __future__ import annotations

# Weights, bands, anchors and limits that results depend on.
SCREEN_WEIGHTS = {"ytd": 5.0, "1y": 15.0, "3y": 40.0, "5y": 25.0, "10y": 15.0}
SCORE_WEIGHTS = {"3y": 40.0, "5y": 30.0, "1y": 20.0, "ytd": 10.0}
VOLATILITY_BANDS = [(4.245, "Very Low"), (7.795, "Low"), (10.235, "Moderate"), (13.595, "High"), (None, "Very High")]
DRAWDOWN_POINTS = [(-5.0, 80.0), (-10.0, 70.0), (-15.0, 60.0), (-25.0, 40.0), (-40.0, 20.0), (None, 10.0)]
FIT_ANCHORS = [(0.0, 0.0), (0.25, 5.0), (0.5, 20.0), (0.75, 50.0), (1.0, 80.0), (1.5, 100.0)]
# profile: (middle target, highest realistic target, risk ceiling, cap of one holding, weights of alpha, fit, efficiency, momentum)
PROFILES = {
    "Conservative": (3.5, 4.0, 2, 50.0, (28.0, 40.0, 25.0, 7.0)),
    "Moderate": (5.0, 6.0, 3, 50.0, (28.0, 40.0, 20.0, 12.0)),
    "Moderately Aggressive": (7.0, 8.0, 4, 60.0, (26.0, 40.0, 17.0, 17.0)),
    "Aggressive": (9.0, 10.0, 5, 70.0, (30.0, 40.0, 13.0, 17.0)),
}
# profile: weights of the cores together, of the gold sleeve and of the money market sleeve, before they are brought to 100
TEMPLATES = {
    "Conservative": (63.5, 6.5, 17.5),
    "Moderate": (63.5, 9.0, 13.5),
    "Moderately Aggressive": (67.5, 9.0, 11.0),
    "Aggressive": (73.0, 10.0, 10.0),
}
RENDER_TOLERANCE = 0.05
STRUCTURAL_ROLES = ("structural:gold", "structural:money_market")
MEASURES = ("alpha", "returnfit", "efficiency", "momentum")
PERIODS = ("ytd", "1y", "3y", "5y", "10y")
# Sectors and the columns that they are summed into, and the places that have a column.
SECTOR_BUCKETS = {
    "Industrial": "Industrial",
    "Technology": "Technology",
    "Financial": "Financial",
    "Communications": "Communications",
    "Telecommunications": "Communications",
    "Internet": "Communications",
    "Consumer, Cyclical": "Consumer Discretionary",
    "Consumer, Non-cyclical": "Consumer Staples",
    "Utilities": "Utilities",
    "Energy": "Energy",
    "Electric": "Energy",
    "Basic Materials": "Materials",
    "Real Estate": "Real Estate",
    "REITS": "Real Estate",
    "Home Builders": "Real Estate",
    "ETF": "Other Sector",
    "Diversified": "Other Sector",
}
NAMED_PLACES = ("USA", "Taiwan", "Korea", "Japan", "France", "Germany", "China", "Singapore", "Netherlands", "Indonesia", "Australia")
