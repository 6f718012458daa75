"""Constants shared by all modules."""

# Sphere and ellipsoid, units, limits.
EARTH_RADIUS_M = 6_371_008.8
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
MAX_RADIUS_M = 40_075_000.0
METERS_PER_DEGREE = 111_000.0
MAX_LAT_FOR_LON = 89.9
MIN_ALTITUDE_M = -11_000.0
MAX_ALTITUDE_M = 100_000.0
KILOMETER = 1_000.0
MILE = 1_609.344
NAUTICAL_MILE = 1_852.0
HOT_ROW_BYTES = 200
BUFFERED_ROW_BYTES = 100
