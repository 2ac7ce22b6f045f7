"""Schemas of point tables and of what is derived from them."""

from __future__ import annotations

CLOUD = "raw_index long, x double, y double, z double"
ORDERED = "rank long, raw_index long, key long, x double, y double, z double"
WINDOWS = "query_id string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
DIRECTORY = (
    "page_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, "
    "valid_count long"
)
#: Records of a page.
PAGE = 128


class OrderingError(ValueError):
    """Ordering failed; ``code`` is one of invalid_shape, invalid_input, unsupported_method, key_encoding_failed."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
