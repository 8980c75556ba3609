"""Engine settings and their effective ranges."""

from __future__ import annotations

from dataclasses import dataclass

SIGNATURES = 12
BAND_ROWS = 3
KEYWORDS = 8
BUCKETED_KEYWORDS = 6
PAGE_SIZE = 50
EVIDENCE_ITEMS = 8
WHOLE_TEXT_PREFIX, ANSWER_PREFIX, KEYWORD_PREFIX, BAND_PREFIX = "tx:", "an:", "kw:", "mh:"


@dataclass(frozen=True)
class Config:
    """Zero or None takes the default; smaller values are raised to the least one."""

    max_bucket: int | None = 120
    max_per_item: int | None = 30
    max_new_pairs: int | None = 5000
    batch_size: int | None = 20

    @property
    def bucket_limit(self) -> int:
        return max(10, int(self.max_bucket or 120))

    @property
    def item_limit(self) -> int:
        return max(5, int(self.max_per_item or 30))

    @property
    def budget(self) -> int:
        return max(1, int(self.max_new_pairs or 5000))

    @property
    def batch(self) -> int:
        return min(100, max(1, int(self.batch_size or 20)))
