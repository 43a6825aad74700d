"""Default settings as frozen dataclasses. They stay on the driver; plans get literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SplitSettings:
    data_salt: str = "data_split"
    answerability_salt: str = "answerability_split"
    validation: float = 0.5
    test: float = 0.5
    answerable: float = 0.7
    unanswerable: float = 0.1
    both: float = 0.2


@dataclass(frozen=True)
class ConstructSettings:
    window_size: int = 1
    max_supports: int = 4
    drop_over_max: bool = True
    title_prefix: bool = True


@dataclass(frozen=True)
class NegativeSettings:
    replace_min: int = 1
    replace_max: int = 1
    radius: int = 1
    any_sentence_fallback: bool = True
    adjacent_limit: int = 1
    title_prefix: bool = True
    seed: int = 42


@dataclass(frozen=True)
class ProtocolSettings:
    max_evidence: int = 4
    max_prompt_tokens: int = 512
    max_completion_tokens: int = 512
    # Refusal templates, the canonical one first, and the order of fields.
    refusals: tuple[str, ...] = (
        "I don't know based on the provided knowledge.",
        "The provided knowledge does not contain enough information to answer the question.",
        "I cannot answer from the provided knowledge.",
    )
    fields: tuple[str, ...] = ("answerability", "evidence", "rationale", "answer", "confidence")


@dataclass(frozen=True)
class JudgeSettings:
    temperature: float = 2.17
    full_margin: float = 0.4
    reject_margin: float = 0.6
    reject_band: float = 0.05
    fail_as_negative: bool = True
    check_type: bool = True

    def __post_init__(self) -> None:
        if self.temperature <= 0 or self.reject_band < 0:
            raise ValueError("temperature must be positive and the reject band not negative")


@dataclass(frozen=True)
class VerifierSettings:
    entail: float = 0.60
    contradict: float = 0.90


@dataclass(frozen=True)
class SelectionSettings:
    parse_ok: float = 0.95
    protocol_ok: float = 0.98
    evidence_ok: float = 0.95


@dataclass(frozen=True)
class PrepareSettings:
    max_prompt_tokens: int = 512
    max_completion_tokens: int = 512
    total: dict[str, int] = field(default_factory=lambda: {"train": 10_000, "validation": 500, "test": 500})
    answerable: dict[str, int] = field(default_factory=lambda: {"train": 8_000, "validation": 400, "test": 400})
    unanswerable: dict[str, int] = field(default_factory=lambda: {"train": 2_000, "validation": 100, "test": 100})
    seed: int = 42
    shuffle: bool = True


@dataclass(frozen=True)
class CalibrationSettings:
    objective: str = "f1"
    reject_alpha: float = 0.5
    reject_search: bool = False
    samples_per_task: int = 200
    #: Lowest, highest and step of the grids.
    temperatures: tuple[float, float, float] = (0.05, 5.0, 0.01)
    margins: tuple[float, float, float] = (0.0, 1.0, 0.05)
    confidences: tuple[float, float, float] = (0.34, 0.95, 0.05)
    bands: tuple[float, float, float] = (0.0, 0.3, 0.05)
    matcher_thresholds: tuple[float, float, float] = (0.1, 0.95, 0.05)


@dataclass(frozen=True)
class Settings:
    splits: SplitSettings = SplitSettings()
    construct: ConstructSettings = ConstructSettings()
    negatives: NegativeSettings = NegativeSettings()
    protocol: ProtocolSettings = ProtocolSettings()
    judge: JudgeSettings = JudgeSettings()
    verifier: VerifierSettings = VerifierSettings()
    selection: SelectionSettings = SelectionSettings()
    prepare: PrepareSettings = field(default_factory=PrepareSettings)
    calibration: CalibrationSettings = CalibrationSettings()
    token_f1: float = 0.85
    matcher: float = 0.27


DEFAULTS = Settings()


# Default tables of the command line, by preset.
PRESETS: dict[str, dict] = {
    "source": {"seed": 42, "max_train_samples": 20_000, "max_validation_samples": 2_000, "enable_unanswerable_nli": True},
    "teacher": {"prompt_style": "teacher_v1", "answerable_candidates": 3, "unanswerable_candidates": 1, "record_token_usage": False},
    "structured_eval": {"split": "validation", "max_samples": -1, "seed": 42, "include_base": False, "batch_size": 32, "max_new_tokens": 512, "prompt_mode": "infer", "fewshot_k": 0, "eval_track": "sft_structured", "eval_variant": "checkpoint"},
    "base_protocol": {"split": "test", "max_samples": -1, "seed": 42, "include_base": True, "batch_size": 32, "max_new_tokens": 512, "prompt_mode": "teacher_fewshot", "fewshot_k": 2, "eval_track": "base_protocol", "eval_variant": "fewshot"},
    "flat_eval": {"split": "test", "max_samples": -1, "seed": 42, "include_base": True, "batch_size": 32, "max_new_tokens": 512, "think_max_new_tokens": 1024, "encourage_refusal": True, "eval_track": "base_task"},
    "grounded": {"split": "train", "max_samples": -1, "enable_semantics": True, "semantic_decision_source": "full_binary", "token_f1": 0.85},
    "loss_curve": {"split": "validation", "max_samples": -1, "include_base": True, "batch_size": 16, "eval_track": "sft_structured", "eval_variant": "checkpoint"},
    "hallucination": {"split": "train", "max_samples": -1, "input_mode": "flat", "answer_source": "answer", "threshold": 0.5, "max_concurrent": 4, "throttle_value": 1},
    "selection": {"parse_ok": 0.95, "protocol_ok": 0.98, "evidence_ok": 0.95},
    "annotation": {"samples_per_task": 200, "seed": 42},
}


def resolve(value, default):
    """An explicit value, or the setting."""
    return default if value is None else value


def resolved(given: dict, preset: str, **extra) -> dict:
    """``given`` with its missing and null entries filled from the preset (then from ``extra``); explicit values
    stay, also false, zero and empty ones. An unknown preset raises."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    defaults = {**extra, **PRESETS[preset]}
    return {**given, **{k: resolve(given.get(k), v) for k, v in defaults.items()}}


def preset_of_mode(mode: str | None) -> str:
    """The preset of structured generation for a prompt mode."""
    return "base_protocol" if (mode or "").strip() == "teacher_fewshot" else "structured_eval"
