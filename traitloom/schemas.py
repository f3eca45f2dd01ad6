"""Table schemas.  Records of every producer are brought to RECORDS."""

RECORDS = (
    "obs_id string, img_id string, source string, species string, genus string, family string, latitude double, longitude double, "
    "observed_at timestamp, img_url string, img_cnt int, license string, annotations array<string>, tags array<string>"
)
INAT_RAW = (
    "obs_id string, usr_id string, date string, latitude string, longitude string, taxon string, img_cnt string, img_id string, file_name string, img_url string, "
    "width string, height string, license string, annotations string, tags string, download_time string, family string, genus string, species string"
)
PIXELS = ("img_id string, y int, x int, r int, g int, b int")
PATCHES = ("img_id string, patch_id int, c1 double, c2 double, c3 double, cx double, cy double, n int")
PALETTE = ("cluster_id string, r int, g int, b int, h double, s double, v double")
ENCODINGS = ("img_id string, features array<float>")
CODINGS = ("id string, category string, value string")
BLOBS = ("name string, stage string, content binary")
STAGES = ("img_id string, stage string")
TRIALS = ("user_name string, trial_number int, click_x int, click_y int, reaction_time_seconds double, found boolean, timed_out boolean")
DOWNLOADS = ("file_name string, file_path string, imgsize string, bytes bigint, img_url string, time string")
#: Terms kept of Darwin Core occurrence records.
DARWIN_CORE = [
    "gbifID", "datasetName", "basisOfRecord", "occurrenceID", "catalogNumber", "recordedBy", "sex", "lifeStage", "occurrenceStatus", "eventDate", "year", "month", "day",
    "continent", "countryCode", "stateProvince", "county", "locality", "decimalLatitude", "decimalLongitude", "coordinateUncertaintyInMeters", "elevation", "scientificName",
    "kingdom", "phylum", "class", "order", "family", "genus", "species", "taxonRank", "license", "identifiedBy",
]
