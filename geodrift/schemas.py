"""Fixed schemas of the tables; missing numbers are NULL, never NaN."""

CATALOGUE = "name string, lat double, lon double, alt double"
ENU = "station string, date date, east double, north double, up double, sige double, sign double, sigu double"
XYZ = "station string, date date, x double, y double, z double"
LOOKUP = "grid_point string, longitude double, latitude double"
GRID = "grid_point string, decimal_year double, east double, north double, up double, sigma_east double, sigma_north double, sigma_up double, rapid_flag int"
TIDY = "station string, date date, measurement string, value double"
RASTER_META = "raster_id string, path string, band int, x0 double, dx double, y0 double, dy double, height int, width int, nodata double, units string, crs string"
RASTER_TILES = "raster_id string, band int, tile_row int, tile_col int, values array<double>"
MEASUREMENTS = ("los_gps", "los_insar", "similarity", "temporal_coherence")
