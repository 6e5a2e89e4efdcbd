"""Values shared by every module."""

KEY = "run_id"

# --- fixed values: units -----------------------------------------------------------------------
LI_KM = 0.415  # one li in km
LI_PER_PX = 10  # one canvas pixel is ten li
KM_PER_PX = 4.15

# --- fixed values: canvas ----------------------------------------------------------------------
CANVAS_WIDTH = 1200
CANVAS_HEIGHT = 750
CANVAS_CENTRE = (600.0, 375.0)
REFERENCE_POINT = (600.0, 500.0)  # pixel of the alignment anchor
START_X = (120.0, 1080.0)
START_Y = (75.0, 675.0)
START_SHRINK = 2.0
DETAIL_BOX = (500.0, 325.0, 800.0, 400.0)

# --- fixed values: anchors ---------------------------------------------------------------------
ALIGN_ANCHOR = "鄯善"
SECOND_ANCHOR = "都護治/烏壘"
CLASS_OVERRIDES = {"都護治/烏壘": 1}

# --- fixed values: forces ----------------------------------------------------------------------
SPRING_STIFFNESS = 15000.0
REPULSION_STRENGTH = 5000.0
DIRECTION_FORCE = 10000.0
MIN_DISTANCE = 0.1

# --- fixed values: projection extent and ellipsoid ------------------------------------------------
LON_RANGE = (73.24516481, 92.74103523)
LAT_RANGE = (37.12265816, 44.2843368)
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GEODESIC_ORIGIN = (89.840644, 40.527633)  # lon, lat

# --- fixed values: compass tokens on screen axes (y grows downwards) -----------------------------
CARDINALS = {"東": (1, 0), "西": (-1, 0), "北": (0, -1), "南": (0, 1)}
DIAGONALS = {"東南": (1, 1), "西北": (-1, -1), "東北": (1, -1), "西南": (-1, 1)}
SYNONYMS = {
    "E": "東", "W": "西", "N": "北", "S": "南",
    "SE": "東南", "NW": "西北", "NE": "東北", "SW": "西南",
}

# --- fixed values: error display, ensemble and layers --------------------------------------------
ERROR_CAP = 0.03
CONFIDENCE_LEVELS = ((0.95, 0.30), (0.90, 0.20), (0.85, 0.10))  # level, opacity
SPRING_JITTER = 0.05
REPULSION_JITTER = 0.20
DENSITY_GRID = (200, 200)
MODEL_FACTOR = 0.412
OVERLAY_SCALE = 1.2 / KM_PER_PX
OVERLAY_OFFSET = (700.0, 500.0)
NODE_COLOURS = ("red", "green", "blue", "orange", "purple", "brown")
SAVED_NODE_CLUSTER = 5
TRUTH_CLUSTER = 2
LOG_FLOOR = 1e-8
