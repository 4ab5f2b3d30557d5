"""Job parameters.

The reference job hard-codes these as constants; here they are one frozen
dataclass so a run is fully described by its parameters and its inputs.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class AffinityParams:
    # The defaults are the original job's parameters (region,
    # tokens, thresholds, sizes, exponent, fractions, tiers).
    # Region filter: people with a location whose `region_column` equals this value.
    region_value: str = "India"
    # Topic discovery: token A must occur in the lower-cased name, token B in the
    # lower-cased name+type, and A's first match must start before B's.
    # Tokens are Java regular expressions, as in the reference.
    token_a: str = "miss"
    token_b: str = "malini"
    # An entity is "big" when its liker-fact count is strictly above this.
    big_min_exclusive: int = 999
    # Off-topic predictors whose likers count as edge likers.
    top_offtopic: int = 200
    # Rows kept in the top-k implication reports.
    report_top: int = 5000
    # Implication score = sum(share) / count ** exponent.
    exponent: float = 0.7
    # Top fractions (rounded down) of topic entities, by liker count, that count
    # as "basic" and "common" for avidity scoring.
    basic_frac: float = 0.05
    common_frac: float = 0.20
    # Ages are measured at this date (the reference uses the wall clock).
    as_of: dt.date = field(default_factory=dt.date.today)
    # Avidity tier thresholds: score >= avid -> Avid, >= intermediate ->
    # Intermediate, >= casual -> Casual, else Non-Fan.
    tier_avid: int = 6
    tier_intermediate: int = 3
    tier_casual: int = 1
    # Largest counted set (locations, topic, big entities, region people, top
    # predictors, census) that is broadcast to executors, in rows and in bytes
    # of its values; a larger one is joined with a shuffle instead.
    broadcast_max_rows: int = 2_000_000
    broadcast_max_bytes: int = 64 << 20
    # People with more than this many times the region likes of a mean shuffle
    # partition are "hot": their facts are joined map-side instead of through
    # the person-keyed shuffle. (So there are fewer hot people than partitions.)
    hot_person_share: float = 0.5
    # Slices over which a key's facts are spread in shuffles by a set beyond
    # the broadcast bound.
    skew_slices: int = 16
    # Entities with more than 1/heavy_keys_max of the region's facts are "heavy":
    # in joins with a set beyond the broadcast bound their facts are joined
    # map-side. (Fewer than heavy_keys_max can be, so their rows always fit.)
    heavy_keys_max: int = 1024
    # Buckets of the region's facts and the frames by person, where these are kept
    # as bucketed tables (about as many as shuffle partitions); 0: not bucketed.
    person_buckets: int = 0
    # Largest number of most-liked topic entities that is taken as a top-k which
    # one task merges; a larger one is cut off at a threshold.
    direct_top_max: int = 10_000

    def fingerprint(self) -> str:
        """Stable hash of all parameters, used to key materialized checkpoints."""
        payload = {
            k: (v.isoformat() if isinstance(v, dt.date) else v)
            for k, v in dataclasses.asdict(self).items()
        }
        blob = json.dumps(payload, sort_keys=True).encode()
        return hashlib.sha256(blob).hexdigest()[:16]


# Parameters that make the driver-generated fixtures exercise every code path
# (see FIXTURES.md section 2).
FIXTURE_PARAMS = AffinityParams(
    region_value="ASIA",
    token_a="red",
    token_b="promo",
    big_min_exclusive=5,
    top_offtopic=20,
    report_top=50,
    exponent=0.7,
    basic_frac=0.05,
    common_frac=0.20,
    as_of=dt.date(2016, 6, 1),
)
