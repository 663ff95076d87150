"""Every threshold and size the stages use, as one immutable value."""

from __future__ import annotations

import dataclasses
import datetime as dt
from dataclasses import dataclass

# Post-launch columns that must never reach a feature table.
LEAKAGE_COLUMNS = (
    "positive", "negative", "pct_pos_total", "num_reviews_total", "pct_pos_recent",
    "num_reviews_recent", "recommendations", "peak_ccu", "estimated_owners",
    "average_playtime_forever", "average_playtime_2weeks", "median_playtime_forever",
    "median_playtime_2weeks", "user_score", "score_rank", "metacritic_score", "discount",
)

# Identifiers and intermediates that are not features either.
INTERMEDIATE_COLUMNS = (
    "appid", "name", "developers", "publishers", "categories", "genres", "tags",
    "supported_languages", "release_date", "owners_lower", "positive_ratio",
    "total_reviews_calc", "wilson_lb", "is_suspicious", "anomaly_score",
)


@dataclass(frozen=True)
class CatalogConfig:
    # cleaning
    as_of: dt.date = dt.date(2025, 3, 10)
    min_days_since_release: int = 180
    min_total_reviews: int = 10
    price_clip_max: float = 100.0
    max_age_rating: int = 21
    # labels
    hit_owners_min: float = 100_000.0
    gem_wilson_min: float = 0.85
    gem_owners_below: float = 100_000.0
    gem_min_reviews: int = 30
    wilson_z: float = 1.96
    # anomaly screen
    anomaly_enabled: bool = True
    contamination: float = 0.02
    exclude_from_gem: bool = True
    anomaly_trees: int = 200
    anomaly_sample: int = 256
    owners_mid_floor: float = 10_000.0
    reviews_per_owner_quantile: float = 0.999
    recommendations_per_review_max: float = 10.0
    # features
    top_genres: int = 15
    top_tags: int = 30
    top_categories: int = 15
    leakage_columns: tuple[str, ...] = LEAKAGE_COLUMNS
    intermediate_columns: tuple[str, ...] = INTERMEDIATE_COLUMNS
    # split
    test_size: float = 0.2
    seed: int = 42
    # text
    tfidf_terms: int = 300
    search_terms: int = 5000
    ngram_max: int = 2
    min_description_chars: int = 20

    def with_(self, **changes) -> "CatalogConfig":
        return dataclasses.replace(self, **changes)
