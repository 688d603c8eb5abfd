"""Table schemas."""

REPORT_FILE = (
    "id string, bug_id bigint, commit string, summary string, description string, report_time string, files string"
)
REPORTS = (
    "project_name string, id string, bug_id bigint, commit string, summary string, description string, "
    "report_time timestamp_ntz, files array<string>, raw_text string"
)
SOURCES = "project_name string, cid int, file string, file_content string"
FEATURES = (
    "report_id string, file string, rVSM_similarity double, collab_filter double, classname_similarity double, "
    "bug_recency double, bug_frequency int, match int"
)
CANDIDATES = "project_name string, cid int, " + FEATURES
CID_TO_BUG = "bug_id string, cid int, match string, commit string, project_name string"
RANKING = "cid int, match int, predicted double, bug_id string"

# Columns of the feature file, in order.
FEATURE_COLUMNS = [
    "report_id",
    "file",
    "rVSM_similarity",
    "collab_filter",
    "classname_similarity",
    "bug_recency",
    "bug_frequency",
    "match",
]

# The three ways to split projects into train and test data.
DATA_SETTINGS = ["cross_project", "within_project", "cross_project_and_within_project"]
