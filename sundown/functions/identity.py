"""Dataset names and consumer ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public dataset URN form, and the prefix and length of a consumer id.
URN_PATTERN = r"(?s)^urn:li:dataset:\(urn:li:dataPlatform:([^,]*),([^,]*),(.*)\)$"
ID_PREFIX = "dh-"
ID_LENGTH = 20

IDENTITY_PARTS = ("platform", "instance", "database", "schema", "table", "environment")


def parse_urn(urn: Column | str) -> Column:
    """Six identity parts, or null unless the name has exactly four non-empty dotted parts."""
    text = F.col(urn) if isinstance(urn, str) else urn

    def group(i: int) -> Column:
        return F.regexp_extract(text, URN_PATTERN, i)

    parts = F.split(group(2), r"\.", -1)
    usable = text.rlike(URN_PATTERN) & (F.size(parts) == 4) & ~F.exists(parts, lambda p: p == "")
    values = (group(1), parts[0], parts[1], parts[2], parts[3], group(3))
    return F.when(usable, F.struct(*[v.alias(n) for v, n in zip(values, IDENTITY_PARTS)]))


def consumer_id(urn: Column | str) -> Column:
    """Short stable id of a consumer."""
    text = F.col(urn) if isinstance(urn, str) else urn
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(text, 256), 1, ID_LENGTH))
