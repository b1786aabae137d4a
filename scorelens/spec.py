"""Feature catalogue: which columns are categorical, which numeric, the target."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """Char features first, then numeric ones (the catalogue order), plus target."""

    char: tuple[str, ...] = field(default_factory=tuple)
    num: tuple[str, ...] = field(default_factory=tuple)
    target: str = "target"

    def __post_init__(self):
        object.__setattr__(self, "char", tuple(self.char))
        object.__setattr__(self, "num", tuple(self.num))

    @property
    def varlist(self) -> list[str]:
        return list(self.char) + list(self.num)

    @property
    def var_types(self) -> list[tuple[str, str]]:
        return [(c, "string") for c in self.char] + [(c, "number") for c in self.num]

    def validate(self, df: DataFrame) -> "FeatureSpec":
        """Check the catalogue against the schema up front (no action)."""
        fields = {f.name: f.dataType for f in df.schema.fields}
        missing = [c for c in self.varlist + [self.target] if c not in fields]
        if missing:
            raise ValueError(f"columns not in DataFrame: {missing}")
        bad_num = [c for c in self.num if not isinstance(fields[c], T.NumericType)]
        if bad_num:
            raise ValueError(f"numeric features with non-numeric type: {bad_num}")
        return self


# The feature catalogue of the `sample` view (see FIXTURES.md part 3).
SAMPLE_SPEC = FeatureSpec(
    char=("segment", "priority", "nation", "segment_null"),
    num=("totalprice", "acctbal", "sparse_num"),
    target="target",
)
