"""Fixed vocabularies: column aliases, produced columns, Darwin Core terms, labels."""

from __future__ import annotations

from pyspark.sql import types as T

#: Aliases of each concept, the first non-blank wins.
LOCALITY = ("Locality verbatim", "label_verbatim", "verbatimLocality", "locality")
COUNTRY = ("Country", "country")
IDENTIFIER = ("Barcode", "catalogNumber", "occurrenceID", "collectionID", "materialEntityID", "recordNumber")
LATITUDE = ("Latitude", "latitude", "decimalLatitude")
LONGITUDE = ("Longitude", "longitude", "decimalLongitude")
VERBATIM_LATITUDE = ("verbatimLatitude",)
VERBATIM_LONGITUDE = ("verbatimLongitude",)
VERBATIM_COORDINATES = ("verbatimCoordinates",)
COMPARE_KEY = IDENTIFIER + ("gbifID", "barcode", "locality_id", "id")
COMPARE_LATITUDE = ("Latitude", "latitude", "lat")
COMPARE_LONGITUDE = ("Longitude", "longitude", "lon", "long")

#: Columns that processing adds, in export order.
PRODUCED = (
    "Country_Processed", "State", "Region", "Sector", "Exact_Site", "Elevation", "Elevation_Original", "Latitude",
    "Longitude", "Coordinate_Radius_Meters", "Coordinate_Source", "Confidence", "Processing_Notes",
)

#: Produced column -> field of the model's response.
RESPONSE_OF = {
    "Country_Processed": "country", "State": "state", "Region": "region", "Sector": "sector", "Exact_Site": "exact_site",
    "Elevation": "elevation_meters", "Elevation_Original": "elevation_original", "Latitude": "latitude", "Longitude": "longitude",
    "Coordinate_Radius_Meters": "coordinate_radius_meters", "Coordinate_Source": "coordinate_source", "Confidence": "confidence",
    "Processing_Notes": "notes",
}

#: Native column -> Darwin Core term.
DARWIN_CORE = {
    "Barcode": "catalogNumber", "Locality verbatim": "verbatimLocality", "Country": "country", "Country_Processed": "country",
    "State": "stateProvince", "Region": "county", "Sector": "municipality", "Exact_Site": "locality",
    "Elevation": "minimumElevationInMeters", "Elevation_Original": "verbatimElevation", "Latitude": "decimalLatitude",
    "Longitude": "decimalLongitude", "Coordinate_Radius_Meters": "coordinateUncertaintyInMeters",
    "Coordinate_Source": "georeferenceProtocol", "Confidence": "georeferenceVerificationStatus", "Processing_Notes": "georeferenceRemarks",
}

#: Agreement categories in report order, with the distance (km) each stays under.
CATEGORIES = (("close (<2km)", 2.0), ("moderate (2-5km)", 5.0), ("low (5-10km)", 10.0), ("none (>10km)", None))
NO_COMPARISON = "no comparison"
CATEGORY_ORDER = tuple(c for c, _ in CATEGORIES) + (NO_COMPARISON,)

COORDINATE_SOURCES = ("coordinates_provided", "grid_reference_converted", "coordinates_extracted", "estimated", "no_coordinates")
CONFIDENCES = ("high", "medium", "low", "unknown")

#: Tracking columns of deduplicated candidates.
DEDUP_KEY, OCCURRENCE_IDS, OCCURRENCE_COUNT = "dedup_key", "occurrence_ids", "occurrence_count"
#: The input ordinal: every "first wins", "last wins" and "input order" rule refers to it.
ROW = "_row"

RESPONSE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("country", "state", "region", "sector", "exact_site")]
    + [T.StructField(n, T.DoubleType()) for n in ("latitude", "longitude", "coordinate_radius_meters", "elevation_meters")]
    + [T.StructField(n, T.StringType()) for n in ("coordinate_source", "confidence", "elevation_original", "notes", "collection_notes")]
)
