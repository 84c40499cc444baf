"""What to detect, how sure to be, and the entity types."""

from __future__ import annotations

from dataclasses import dataclass, field

# Entity type, name to show, colour, description.
ENTITY_TYPES = (
    ("PERSON", "Person", "#3B82F6", "Person names"),
    ("ORG", "Organization", "#10B981", "Company or organization names"),
    ("LOC", "Location", "#F59E0B", "Places and addresses"),
    ("DATE", "Date", "#6B7280", "Dates and time references"),
    ("SSN", "SSN", "#EF4444", "Social Security Numbers"),
    ("CREDIT_CARD", "Credit Card", "#DC2626", "Credit card numbers"),
    ("PHONE", "Phone", "#F97316", "Phone numbers"),
    ("EMAIL", "Email", "#8B5CF6", "Email addresses"),
    ("CUSTOM", "Custom", "#EC4899", "User-defined patterns"),
)
TYPES = tuple(t for t, *_ in ENTITY_TYPES)
# Confidence thresholds (all inclusive) by name and by level of caution.
HIGH, MEDIUM, LOW = 0.9, 0.7, 0.5
THRESHOLDS = {"conservative": HIGH, "balanced": MEDIUM, "aggressive": LOW}
# Context windows in characters, and the boost where a pattern states none.
CONTEXT_SHOWN, CONTEXT_WINDOW, BOOST = 50, 10, 1.2


@dataclass(frozen=True)
class DetectionConfig:
    types: tuple[str, ...] = TYPES
    level: str = "balanced"
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    use_regex: bool = True
    use_ml: bool = False
    sanitize: bool = False
    #: Scripts to assume in place of those detected in each text.
    force_scripts: tuple[str, ...] | None = None

    @property
    def threshold(self) -> float:
        return self.thresholds.get(self.level, self.thresholds["aggressive"])
