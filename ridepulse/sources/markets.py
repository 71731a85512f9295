"""The ride model's markets: city boxes and city weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Bounding box of each city id: (id, lat_min, lat_max, lon_min, lon_max).
CITY_BOXES = [
    (1, 40.4774, 40.9176, -74.2591, -73.7004),
    (2, 33.7037, 34.3373, -118.6682, -118.1553),
    (3, 41.6445, 42.0230, -87.9401, -87.5240),
    (4, 29.5239, 30.1108, -95.7835, -95.0146),
    (5, 33.2148, 33.9187, -112.3241, -111.9253),
    (6, 39.8670, 40.1379, -75.2803, -74.9558),
    (7, 29.2098, 29.6659, -98.8088, -98.2340),
    (8, 32.5343, 33.1139, -117.2817, -116.9057),
    (9, 32.6177, 33.0237, -97.0000, -96.5546),
    (10, 37.1255, 37.4697, -122.0436, -121.5886),
    (11, 33.4018, 33.6012, -86.9958, -86.6360),
    (12, 61.0767, 61.3717, -150.1626, -149.5561),
    (13, 34.6243, 34.8432, -92.4899, -92.1722),
    (14, 39.6143, 39.9142, -105.1099, -104.5997),
    (15, 41.7137, 41.8137, -72.7331, -72.6331),
    (16, 39.6846, 39.7846, -75.5993, -75.4993),
    (17, 38.7916, 38.9958, -77.1198, -76.9094),
    (18, 30.1029, 30.5850, -82.0551, -81.3971),
    (19, 33.6100, 33.8886, -84.5516, -84.2898),
    (20, 21.2541, 21.3941, -157.9541, -157.8141),
    (21, 43.5318, 43.7318, -116.3284, -116.1284),
    (22, 39.6326, 39.9271, -86.3282, -85.9503),
    (23, 41.5308, 41.6508, -93.6908, -93.5308),
    (24, 37.6176, 37.7776, -97.4136, -97.2136),
    (25, 38.0674, 38.3785, -85.9437, -85.4884),
    (26, 29.8758, 30.0758, -90.1400, -89.9400),
    (27, 43.6181, 43.7181, -70.3289, -70.2289),
    (28, 39.1972, 39.3722, -76.7112, -76.5290),
    (29, 42.2279, 42.3979, -71.1912, -70.9912),
    (30, 42.2550, 42.4550, -83.2879, -82.9879),
    (31, 44.8896, 45.0512, -93.3290, -93.1938),
    (32, 32.2241, 32.3841, -90.2641, -90.1041),
    (33, 38.8779, 39.3067, -94.7541, -94.3644),
    (34, 45.7033, 45.8433, -108.5901, -108.4301),
    (35, 41.1660, 41.3999, -96.2400, -95.8677),
    (36, 36.0756, 36.3849, -115.3816, -115.0625),
    (37, 42.9406, 43.0406, -71.5006, -71.4006),
    (38, 40.6901, 40.7901, -74.2201, -74.1201),
    (39, 34.9479, 35.2181, -106.8813, -106.4683),
    (40, 42.8264, 42.9664, -78.9264, -78.7664),
    (41, 35.0175, 35.3723, -81.0090, -80.6512),
    (42, 46.8322, 46.9322, -96.8896, -96.7296),
    (43, 39.8620, 40.1563, -83.2008, -82.7713),
    (44, 35.3378, 35.6495, -97.7696, -97.2673),
    (45, 45.4325, 45.6524, -122.8367, -122.4718),
    (46, 40.3613, 40.5013, -80.0952, -79.9352),
    (47, 41.7801, 41.8601, -71.4701, -71.3701),
    (48, 33.9801, 34.1001, -81.1101, -80.9501),
    (49, 43.4800, 43.6200, -96.8200, -96.6600),
    (50, 35.9946, 36.4066, -87.0599, -86.5159),
    (51, 40.6900, 40.8100, -111.9400, -111.8200),
    (52, 44.4459, 44.5059, -73.2459, -73.1859),
    (53, 36.6801, 36.9201, -76.1001, -75.9001),
    (54, 47.4919, 47.7341, -122.4596, -122.2244),
    (55, 38.2701, 38.4101, -81.7401, -81.5801),
    (56, 42.9215, 43.1928, -88.0706, -87.8467),
    (57, 41.0800, 41.2000, -104.8700, -104.7700),
]

# How often rides start in each city id: (id, weight).
CITY_WEIGHTS = [
    (1, 12), (2, 10), (3, 8), (4, 7), (5, 5), (6, 5), (7, 4), (8, 4), (9, 6), (10, 4),
    (11, 2), (12, 1), (13, 1), (14, 4), (15, 2), (16, 1), (17, 5), (18, 3), (19, 5), (20, 2),
    (21, 1), (22, 2), (23, 1), (24, 1), (25, 2), (26, 3), (27, 1), (28, 3), (29, 5), (30, 3),
    (31, 3), (32, 1), (33, 2), (34, 1), (35, 1), (36, 4), (37, 1), (38, 3), (39, 2), (40, 2),
    (41, 3), (42, 1), (43, 3), (44, 2), (45, 3), (46, 2), (47, 1), (48, 1), (49, 1), (50, 3),
    (51, 2), (52, 1), (53, 2), (54, 5), (55, 1), (56, 2), (57, 1),
]


def city_boxes(spark: SparkSession) -> DataFrame:
    """The boxes as a small local table for ``quality.coordinate_check`` and ``locate_city``."""
    return spark.createDataFrame(
        CITY_BOXES, "city_id long, lat_min double, lat_max double, lon_min double, lon_max double")
