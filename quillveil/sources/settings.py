"""Settings and word lists as JSON."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from ..config import DetectionConfig
from ..functions.words import Word

VERSION = "1.0"


def export(config: DetectionConfig | None = None, words: list[Word] = (), custom: list[dict] | None = None) -> str:
    out: dict = {"version": VERSION, "exportDate": datetime.now(UTC).isoformat()}
    if config:
        out["settings"] = {"types": list(config.types), "level": config.level, "thresholds": config.thresholds, "useRegex": config.use_regex, "useML": config.use_ml, "sanitizeDocument": config.sanitize}
    if words:
        out["predefinedWords"] = [{"id": w.id, "word": w.word, "caseSensitive": w.case_sensitive, "wholeWord": w.whole_word, "createdAt": w.created_at} for w in words]
    if custom:
        out["customPatterns"] = custom
    return json.dumps(out, ensure_ascii=False, indent=2)


def load_config(text: str | None) -> DetectionConfig:
    """Settings from their JSON; defaults where it is missing or unreadable."""
    try:
        s = json.loads(text or "")
        default = DetectionConfig()
        return DetectionConfig(tuple(s.get("types", default.types)), s.get("level", default.level), s.get("thresholds", default.thresholds), s.get("useRegex", True), s.get("useML", False), s.get("sanitizeDocument", False))
    except (ValueError, AttributeError, TypeError):
        return DetectionConfig()


def load_words(text: str | None) -> list[Word]:
    """Words from a JSON list; none where it is missing or unreadable."""
    try:
        return [Word(w["word"], w.get("caseSensitive", False), w.get("wholeWord", True), w["id"], w["createdAt"]) for w in json.loads(text or "[]")]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []


def load(text: str) -> dict:
    """{success, imported, errors, config, words, custom} from an export; words replace a list as a whole."""
    out: dict = {"success": False, "imported": [], "errors": [], "config": None, "words": None, "custom": None}
    try:
        data = json.loads(text)
    except ValueError as e:
        return out | {"errors": [f"not JSON: {e}"]}
    if not isinstance(data, dict) or not data.get("version"):
        return out | {"errors": ["no version"]}
    if "settings" in data:
        out["config"] = load_config(json.dumps(data["settings"]))
        out["imported"].append("settings")
    if data.get("predefinedWords"):
        out["words"] = load_words(json.dumps(data["predefinedWords"]))
        out["imported"].append("predefinedWords")
    if data.get("customPatterns"):
        out["custom"] = data["customPatterns"]
        out["imported"].append("customPatterns")
    if not out["imported"]:
        out["errors"].append("nothing to import")
    out["success"] = bool(out["imported"])
    return out
