"""Fixed values that results depend on."""

ALPHA = 0.5  # damping
EPSILON = 1e-4  # residuals below it aren't pushed on
ROUNDS = 20  # of synchronous pushes; the rest of the series is below 1e-5
TOP_K = 20
MIN_GAP_SECS = 0.5
MAX_GAP_SECS = 600.0
REPEAT_SECS = 60.0
REPEAT_SLOTS = 8
OPEN_WEIGHT = 1.0
EDIT_WEIGHT = 1.0
EDGE_WEIGHT = 1.0
EDGE_MIN_WEIGHT = 0.01
DECAY_INTERVAL_SECS = 3600
HALF_LIFE_SECS = 14 * 86400
SNAPSHOT_SECS = 300
MIN_TOKEN_BYTES = 2
BOUNDARIES = ".-_ "
