"""Parameters and fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass

# These lists must be as they are for right results.
STOPWORDS = (
    "de", "la", "el", "en", "y", "que", "a", "los", "del", "se", "un", "una",
    "con", "es", "no", "lo", "por", "su", "le", "da", "las", "al", "como",
    "pero", "más", "si", "ya", "hay", "me", "este", "mi", "para", "o", "te",
    "yo", "muy", "eso", "esto", "era", "fue", "han", "ha", "he", "ser",
    "estar", "bien", "cuando", "qué", "porque", "ahí", "así", "ese", "tan",
    "todo", "nada", "nos", "les", "donde", "vez", "hacer", "pues", "ahora",
    "también", "solo", "igual", "entonces",
)
FILLERS = (
    "eh", "eeh", "eeeh", "ah", "ahm", "uh", "uhm", "um", "mm", "mmm", "mhm",
    "hmm", "hm", "oye", "veamos", "vamos", "bueno", "tipo", "osea", "ok",
    "okay", "oka", "claro", "sí", "si", "no", "pues", "este", "sea",
)
TRANSITIONS = (
    "cambiando de tema", "otra cosa", "por cierto", "ahora bien", "hablando de",
    "pasando a", "antes de continuar", "de hecho", "en fin", "dejando eso",
    "al margen", "volviendo a", "y bueno", "como decía", "a otra cosa",
    "ya que estamos", "de todas formas", "de todas maneras", "dicho esto",
    "y ya", "nada más", "y nada",
)
HIGHLIGHT_STOPWORDS = (
    "de", "la", "el", "un", "una", "y", "a", "me", "te", "se", "lo", "le",
    "que", "en", "es", "con", "por", "para", "como", "pero",
    "o", "al", "del", "las", "los", "mi", "tu", "su", "más", "hay",
    "muy", "tan", "qué", "cómo", "porque", "cuando", "donde", "esto",
    "esta", "ese", "esa", "yo", "él", "tú", "va", "ha", "está",
)
HIGHLIGHT_GROUPS = (
    ("no", "nada", "nunca", "jamás"),
    ("me", "yo", "mi", "mío"),
    ("sí", "claro", "obvio", "exacto"),
)


@dataclass(frozen=True)
class Segmentation:
    """Parameters of the hybrid segmentation."""

    decay_rate: float = 0.20
    momentum_threshold: float = 0.12
    text_boost: float = 0.15
    min_richness: float = 8.0
    merge_gap: float = 4.0
    max_clip: float = 120.0
    min_clip: float = 8.0
    max_candidates: int = 25
    min_confidence: float = 0.15
    similarity: float = 0.25
    break_confidence: float = 0.45
    dense_rate: float = 3.0
    split_score: float = 0.30
    breaks_follow_window: bool = False


@dataclass(frozen=True)
class Trim:
    """Parameters of the search for a stream's real start and end."""

    scan_s: float = 600.0
    frames_per_second: float = 31.25
    activity_s: float = 8.0
    active_share: float = 0.55
    min_density: float = 0.5
    safe_start_s: float = 30.0
    sustained_s: float = 4.0
    sustained_text_s: float = 30.0
    silence_s: float = 20.0
    silence_share: float = 0.15
    buffer_s: float = 5.0
    long_buffer_s: float = 10.0
    consistency_s: float = 30.0
    min_kept_s: float = 60.0
