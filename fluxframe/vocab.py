"""Closed vocabularies. All tables here are fixed values that define results."""

from __future__ import annotations

# Predictor columns in model order.
PREDICTORS = (
    "DOY", "TOD", "TA", "P", "RH", "VPD", "PA", "CO2",
    "SW_IN", "SW_IN_POT", "SW_OUT", "LW_IN", "LW_OUT", "NETRAD",
    "PPFD_IN", "PPFD_OUT", "WS", "WD", "USTAR",
    "SWC_1", "SWC_2", "SWC_3", "SWC_4", "SWC_5",
    "TS_1", "TS_2", "TS_3", "TS_4", "TS_5", "WTD", "G", "H",
)

# Flux targets and the three static predictors.
TARGETS = ("NEE", "GPP_DT", "GPP_NT", "RECO_DT", "RECO_NT", "FCH4", "LE")
STATIC = ("lat", "lon", "elev")
TARGET_LIMIT = 100.0
STATIC_SCALE = {"lat": 180.0, "lon": 180.0, "elev": 8000.0}

# Land-cover classes known to the model, in embedding order.
CLASSES = ("ENF", "MF", "WET", "CRO", "GRA", "WAT", "SAV", "DBF", "CSH",
           "OSH", "EBF", "WSA", "BSV", "URB", "DNF", "CVM", "SNO")

# Land-cover code -> class. Ingest leaves codes 13 and 16 empty,
# relabelling fills them.
CLASS_OF_CODE = {
    0: "WAT", 1: "ENF", 2: "EBF", 3: "DNF", 4: "DBF", 5: "MF", 6: "CSH", 7: "OSH",
    8: "WSA", 9: "SAV", 10: "GRA", 11: "WET", 12: "CRO", 13: "URB", 14: "CVM",
    15: "SNO", 16: "BSV",
}
CODES_EMPTY_AT_INGEST = (13, 16)

# Fixed values: (lower bound, upper bound, cyclic) per variable. SWC_* and WTD
# are stored the wrong way round on purpose; see functions.scalars.normalise.
BOUNDS = {
    "DOY": (0.0, 366.0, True),
    "TOD": (0.0, 24.0, True),
    "TA": (-80.0, 80.0, False),
    "P": (0.0, 100.0, False),
    "RH": (0.0, 100.0, False),
    "VPD": (0.0, 110.0, False),
    "PA": (0.0, 110.0, False),
    "CO2": (0.0, 750.0, False),
    "SW_IN": (-1500.0, 1500.0, False),
    "SW_IN_POT": (-1500.0, 1500.0, False),
    "SW_OUT": (-500.0, 500.0, False),
    "LW_IN": (-1000.0, 1000.0, False),
    "LW_OUT": (-1000.0, 1000.0, False),
    "NETRAD": (-1000.0, 1000.0, False),
    "PPFD_IN": (-2500.0, 2500.0, False),
    "PPFD_OUT": (-1000.0, 1000.0, False),
    "WS": (-100.0, 100.0, False),
    "WD": (0.0, 360.0, True),
    "USTAR": (-4.0, 4.0, False),
    "SWC_1": (100.0, 0.0, False),
    "SWC_2": (100.0, 0.0, False),
    "SWC_3": (100.0, 0.0, False),
    "SWC_4": (100.0, 0.0, False),
    "SWC_5": (100.0, 0.0, False),
    "TS_1": (-40.0, 40.0, False),
    "TS_2": (-40.0, 40.0, False),
    "TS_3": (-40.0, 40.0, False),
    "TS_4": (-40.0, 40.0, False),
    "TS_5": (-40.0, 40.0, False),
    "WTD": (3.0, -3.0, False),
    "G": (-700.0, 700.0, False),
    "H": (-700.0, 700.0, False),
    "LE": (-700.0, 700.0, False),
}

# Surface-water class 0..7 -> 1 water, 0 land.
WATER_OF_CLASS = (1, 0, 0, 1, 1, 1, 1, 1)

# Image tensor layout and raster geometry.
CHANNELS, TILE_PIXELS = 9, 8
PIXELS = TILE_PIXELS * TILE_PIXELS
CELL_DEGREES = 0.25
CELLS_PER_DEGREE = 4
GRID_ROWS, GRID_COLS = 720, 1440

# Robinson coefficients every 5 degrees of latitude.
ROBINSON_X = (1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962,
              0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322)
ROBINSON_Y = (0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571,
              0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0)
ROBINSON_SCALE = (0.8487, 1.3523)

# Legend order, colours and long names of the map classes.
MISSING_CLASS = "NULL"
UNKNOWN_CLASS = "unknown"
LEGEND = (
    ("NULL", "#8F9693", "Changed region"),
    ("ENF", "#006837", "Evergreen needleleaf forest"),
    ("EBF", "#008B45", "Evergreen broadleaf forest"),
    ("DNF", "#A6CEE3", "Deciduous needleleaf forest"),
    ("DBF", "#1F78B4", "Deciduous broadleaf forest"),
    ("MF", "#B2DF8A", "Mixed forest"),
    ("CSH", "#6A3D9A", "Closed shrublands"),
    ("OSH", "#FB9A99", "Open shrublands"),
    ("WSA", "#E31A1C", "Woody savannas"),
    ("SAV", "#FF7F00", "Savannas"),
    ("GRA", "#FDBF6F", "Grasslands"),
    ("WET", "#CAB2D6", "Permanent wetlands"),
    ("CRO", "#8073AC", "Croplands"),
    ("URB", "#FFFF99", "Urban and built-up"),
    ("CVM", "#B15928", "Cropland/Natural vegetation mosaic"),
    ("WAT", "#FFFFFF", "Water bodies"),
    ("SNO", "#FFFFFF", "Snow and ice"),
    ("BSV", "#FFFFFF", "Barren or sparsely vegetated"),
)
LEGEND_HIDDEN = ("WAT", "SNO", "BSV", "URB", "CRO")
FALLBACK_COLOURS = ("#377EB8", "#4DAF4A", "#984EA3", "#FF7F00",
                    "#FFFF33", "#A65628", "#F781BF", "#999999")

# Fixed values: (class, NSE A, RMSE A, NSE B, RMSE B) for NEE, where A is a
# gradient-boosting model and B an earlier attention model.
EARLIER_SCORES = (
    ("CRO", 0.8066, 3.2381, 0.8482, 2.8677),
    ("CSH", 0.7510, 1.5224, 0.7670, 1.4709),
    ("CVM", 0.5277, 5.5157, 0.5763, 5.2236),
    ("DBF", 0.7250, 4.0959, 0.7547, 3.8678),
    ("DNF", 0.2803, 4.0974, 0.4336, 3.6322),
    ("EBF", 0.7966, 4.6050, 0.8220, 4.3070),
    ("ENF", 0.7765, 2.8141, 0.7694, 2.8579),
    ("GRA", 0.7461, 3.2487, 0.7967, 2.9059),
    ("MF", 0.7559, 3.8633, 0.7717, 3.7361),
    ("OSH", 0.5451, 1.8796, 0.6060, 1.7475),
    ("SAV", 0.5802, 1.6514, 0.7368, 1.3070),
    ("SNO", -0.0370, 1.4291, 0.2898, 1.1816),
    ("WAT", -11.0524, 3.1838, -14.4010, 3.5802),
    ("WET", 0.4530, 2.2073, 0.4137, 2.2830),
    ("WSA", 0.6132, 2.5153, 0.6267, 2.4706),
)
