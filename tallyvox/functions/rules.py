"""Scalar rules as Column expressions. A missing value is null, never NaN: comparisons with it fall through, means skip it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the triage rules and their texts.
NOISE_BETTI_DIFF_MAX, NOISE_DICE_MIN, NOISE_UNCERTAINTY_MAX = 5, 0.50, 0.15
CLEAN_DICE_MIN, CLEAN_INTER_MIN, CLEAN_BETTI_DIFF_MAX = 0.82, 0.85, 2
CLEAN, WEAK, NOISE, TEACHER, LEGACY_REJECT = "CLEAN_HIGH_CONFIDENCE", "WEAK_COARSE", "NOISE_REJECT", "AUTO_TOTALESEARCHATOR", "REJECT_OR_TRIAGE"
ACTIONS = {
    NOISE: "Auto-Exclude (Discard from Training Pool)",
    CLEAN: "Auto-Approve for GKD Distillation & VAE",
    WEAK: "Apply Hard Thresholding (Set Conflicting Pixels to Ignore Class)",
}
ORGANS = {1: "stomach", 2: "duodenum", 3: "small_bowel", 4: "colon"}
# Fixed label remaps, source to target; others become 0. FULL_BODY and EXPERT give 57 different meanings. EXPERT is by model;
# a class with two targets is split at half the depth.
FULL_BODY = {18: 1, 50: 1, 55: 1, 19: 2, 51: 2, 56: 2, 20: 3, 52: 3, 57: 3, 5: 4, 6: 4, 53: 4, 58: 4}
SIX_TO_FOUR = {2: 1, 3: 2, 4: 3, 5: 3, 6: 4}
EXPERT = {
    "MedNeXt": {1: (2, 2), 2: (3, 3), 3: (4, 5), 4: (6, 6)},
    "Swin-UNETR": {1: (2, 2), 2: (3, 3), 3: (4, 5), 4: (6, 6)},
    "EnsembleConsensus": {1: (2, 2), 2: (3, 3), 3: (4, 5), 4: (6, 6)},
    "TotalSegmentator": {18: (2, 2), 19: (3, 3), 20: (4, 5), 57: (6, 6)},
}
IGNORE = 255


def triage(dice: Column, inter: Column, betti: Column, entropy: Column) -> Column:
    """Category of a scan from its (rounded) means; the first rule that fits wins."""
    return (
        F.when((betti > NOISE_BETTI_DIFF_MAX) | (dice < NOISE_DICE_MIN) | (entropy > NOISE_UNCERTAINTY_MAX), NOISE)
        .when((dice >= CLEAN_DICE_MIN) & (inter >= CLEAN_INTER_MIN) & (betti <= CLEAN_BETTI_DIFF_MAX), CLEAN)
        .otherwise(WEAK)
    )


def action(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in ACTIONS.items():
        out = F.when(category == name, text).otherwise(out)
    return out


def legacy_triage(dice: Column, betti: Column) -> Column:
    """The report's own rule; a missing Dice is weak."""
    return F.when((dice < NOISE_DICE_MIN) | (betti > NOISE_BETTI_DIFF_MAX), LEGACY_REJECT).when(dice >= CLEAN_DICE_MIN, CLEAN).otherwise(WEAK)


def outcome(mean_dice: Column, reject_rate: Column) -> Column:
    return F.when((mean_dice >= 0.82) & (reject_rate < 0.05), "A").when(mean_dice >= 0.65, "B").otherwise("C")


def composite(dice: Column, hd95: Column) -> Column:
    """0.4 * dice + 0.6 * max(0, 1 - hd95 / 50); a missing distance adds nothing."""
    return 0.4 * dice + 0.6 * F.coalesce(F.greatest(F.lit(0.0), 1 - hd95 / 50), F.lit(0.0))


def winner(first: Column, second: Column, names: tuple[str, str], margin: float = 0.005) -> Column:
    return (
        F.when(first.isNull() & second.isNull(), "N/A").when(first.isNull(), names[1]).when(second.isNull(), names[0])
        .when(second > first + margin, names[1]).when(first > second + margin, names[0]).otherwise("Tie")
    )


def clamp_label(label: Column, low: int = 0, high: int = 4) -> Column:
    return F.when(label.between(low, high), label).otherwise(0)


def remap(label: Column, table: dict[int, int]) -> Column:
    """A label through a fixed remap; what isn't listed is 0."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, label), F.lit(0))


def remap_split(label: Column, z: Column, depth: Column, scheme: str) -> Column:
    """The expert remap: one class is split at half the depth, the lower part first."""
    out = F.lit(0)
    for source, (below, above) in EXPERT[scheme].items():
        out = F.when(label == source, F.when(z < F.floor(depth / 2), below).otherwise(above)).otherwise(out)
    return out


def autolabel(human: Column, consensus: Column) -> Column:
    """The human label, or the ignore class where it's foreground and the consensus disagrees."""
    return F.when((human > 0) & (human != consensus), IGNORE).otherwise(human)


def window_intensity(hu: Column, low: float = -175.0, high: float = 250.0) -> Column:
    return F.least(F.greatest((hu - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def number(text: Column) -> Column:
    """A number from a string, null where it isn't one."""
    return text.try_cast("double")


def subject_of(name: Column) -> Column:
    """A file's subject: the longest known suffix goes."""
    return F.regexp_replace(name, "(_gi_seg|_gi_mask|_consensus|_autolabel|_seg)?(\\.nii)?(\\.gz)?$", "")


def numeric_key(name: Column) -> Column:
    """The first run of 6 to 8 digits, null without one."""
    return F.nullif(F.regexp_extract(name, "(\\d{6,8})", 1), F.lit(""))


def cosine_rate(step: Column, steps: int, rate: float, least: float = 1e-6) -> Column:
    return least + (rate - least) * (1 + F.cos(F.lit(3.141592653589793) * step / steps)) / 2


def entropy(p: Column, low: float = 1e-7) -> Column:
    """Base-2 entropy of an array of probabilities, each held within [low, 1 - low]; a single probability p counts as (p, 1 - p)."""
    held = F.transform(p, lambda x: F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(1 - low)))
    both = F.when(F.size(p) == 1, F.concat(held, F.transform(held, lambda x: 1 - x))).otherwise(held)
    return F.aggregate(both, F.lit(0.0), lambda acc, x: acc - x * F.log2(x))


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x.cast("double") - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def one_hot(label: Column, classes: int = 5) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("int"))


def top_class(p: Column) -> Column:
    """Index of the largest element, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")
