"""Names and codes that results must carry unchanged."""

# Campaign states.
CAMPAIGN_STATES = (
    "PROPOSED", "INVENTORIED", "MIGRATING", "RECONCILING", "READY", "RETIRED", "BLOCKED",
)

# Consumer dispositions.
DISPOSITIONS = (
    "DISCOVERED", "IDENTIFIED", "CHANGE_PROPOSED", "APPLIED", "VALIDATED", "REMOVED",
    "NOT_APPLICABLE", "WAIVED", "OPAQUE", "UNRESOLVED", "STALE", "FAILED",
)
CLOSED_DISPOSITIONS = ("VALIDATED", "REMOVED", "NOT_APPLICABLE")
OPEN_DISPOSITIONS = (
    "DISCOVERED", "IDENTIFIED", "CHANGE_PROPOSED", "APPLIED", "OPAQUE", "STALE", "FAILED",
)
# Dispositions an inventory may import, and those only a dedicated event may set.
IMPORTABLE_DISPOSITIONS = ("DISCOVERED", "IDENTIFIED", "OPAQUE", "UNRESOLVED")
DEDICATED_DISPOSITIONS = ("VALIDATED", "REMOVED", "NOT_APPLICABLE", "WAIVED")

DECISIONS = ("READY_TO_RETIRE", "REVIEW_REQUIRED", "BLOCKED", "UNSAFE")
EVIDENCE_STATUSES = ("COMPLETE", "PARTIAL", "UNKNOWN", "UNAVAILABLE", "STALE")

# Legal campaign moves.
CAMPAIGN_MOVES = {
    "PROPOSED": ("INVENTORIED", "BLOCKED"),
    "INVENTORIED": ("MIGRATING", "RECONCILING", "BLOCKED"),
    "MIGRATING": ("RECONCILING", "BLOCKED"),
    "RECONCILING": ("READY", "BLOCKED"),
    "READY": ("RETIRED", "RECONCILING", "BLOCKED"),
    "RETIRED": (),
    "BLOCKED": ("INVENTORIED", "MIGRATING", "RECONCILING", "BLOCKED"),
}

# Legal consumer moves.
CONSUMER_MOVES = {
    "DISCOVERED": ("IDENTIFIED", "OPAQUE", "UNRESOLVED", "NOT_APPLICABLE"),
    "IDENTIFIED": ("CHANGE_PROPOSED", "REMOVED", "NOT_APPLICABLE", "WAIVED", "STALE"),
    "CHANGE_PROPOSED": ("APPLIED", "FAILED", "STALE"),
    "APPLIED": ("VALIDATED", "FAILED", "STALE"),
    "VALIDATED": ("STALE",),
    "REMOVED": ("STALE",),
    "NOT_APPLICABLE": ("STALE",),
    "WAIVED": ("IDENTIFIED", "STALE"),
    "OPAQUE": ("IDENTIFIED", "NOT_APPLICABLE", "WAIVED"),
    "UNRESOLVED": ("IDENTIFIED", "NOT_APPLICABLE", "WAIVED"),
    "STALE": ("IDENTIFIED", "CHANGE_PROPOSED", "FAILED"),
    "FAILED": ("CHANGE_PROPOSED", "STALE", "WAIVED"),
}

# Fault variants: name, salt added to the seed, recorded mutation.
FAULTS = {
    "null-inflated": (101, "set-to-null"),
    "semantic-drift": (202, "replace-with-different-valid-status"),
    "unmapped-value": (303, "set-to-unmapped-category"),
}
UNMAPPED_VALUE = "__unmapped__"

# Clock bounds, in seconds.
FUTURE_SKEW_SECONDS = 30
SOURCE_SKEW_SECONDS = 300
PLAN_LIFETIME_SECONDS = 15 * 60

SCAN_SUFFIXES = (".py", ".sql", ".yaml", ".yml")
# Folders the scope scan and the reference scan never enter.
SCOPE_SKIPPED_FOLDERS = (".git", ".venv", "dbt_packages", "logs", "target")
REFERENCE_SKIPPED_FOLDERS = (".git", ".runtime", ".venv", "dbt_packages", "logs", "target")


def pairs(moves: dict[str, tuple[str, ...]]) -> list[str]:
    """``FROM>TO`` strings for every legal move."""
    return [f"{start}>{end}" for start, ends in moves.items() for end in ends]
