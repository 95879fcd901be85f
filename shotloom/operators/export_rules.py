"""What a timeline item may hold and an export can't honour: an ordered table of rules over its JSON.

Each rule is a condition and a message; the first that holds decides. Properties may be plain or
wrapped as {"value": x}, and may carry keyframes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.style import PRESETS

VISUAL = ("video", "image", "overlay")
#: Blocks of the advanced state that can't be honoured, in their order. Fixed values.
ADVANCED_BLOCKS = (("trackingTargets", "Tracking metadata"), ("autoReframe", "Auto-reframe metadata"), ("freezeFrames", "Freeze frames"), ("timeRemap", "Time remapping"))
#: Style properties that may be set but not animated. Fixed values.
STATIC_STYLE = tuple(f"adjust.{n}" for n in ("exposure", "brightness", "contrast", "temperature", "tint", "saturation", "vibrance")) + ("color.lift", "color.gamma", "color.gain", "filters.lutLibrary", "filters.intensity", "filters.blend")
#: Numbers that must keep their default, by message. Fixed values.
TONAL = {"adjust.highlights": 100, "adjust.shadows": 100, "adjust.whites": 0, "adjust.blacks": 0, "adjust.sharpness": 0, "adjust.clarity": 0}
GRAIN = {"color.vignette": 0, "color.grain": 0}
MASK = {"mask.top": 0, "mask.bottom": 0, "mask.left": 0, "mask.right": 0, "mask.cornerRadius": 0, "mask.feather": 0, "mask.expansion": 0, "mask.maskFeather": 10, "mask.maskSize": 50}
MOVES = {"animation.scaleAnim": 0, "animation.rotationAnim": 0}
AUDIO_ITEM = {"noiseReduction.level": 50, "eq.low": 0, "eq.mid": 0, "eq.high": 0, "speedSettings.speedMultiplier": 1}
VIDEO_SOUND = ("normalize", "noiseRem", "voiceEnhance", "compressor", "limiter")


def property_text(json: Column, path: str) -> Column:
    """A property's text, with {"value": x} unwrapped; null if it is absent."""
    group, name = path.split(".")
    return F.coalesce(F.get_json_object(json, f"$.properties.{group}.{name}.value"), F.get_json_object(json, f"$.properties.{group}.{name}"))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _truthy(json: Column, path: str) -> Column:
    return _yes(~F.get_json_object(json, path).isin("false", "0", "0.0", "", "[]", "{}", "null"))


def _set(json: Column, path: str) -> Column:
    return _yes(~property_text(json, path).isin("false", "0", "0.0", "", "[]", "{}", "null"))


def _other(json: Column, path: str, default: str) -> Column:
    return _yes(~property_text(json, path).isin("", default))


def _animated(json: Column, path: str) -> Column:
    group, name = path.split(".")
    keys = F.get_json_object(json, f"$.properties.{group}.{name}.keyframes")
    return _yes(F.startswith(keys, F.lit("[")) & (keys != "[]"))


def _differs(json: Column, numbers: dict[str, float], keyframes: bool = False) -> Column:
    found = F.lit(False)
    for path, default in numbers.items():
        found = found | _yes(F.abs(property_text(json, path).try_cast("double") - default) > 1e-6)
        if keyframes:
            found = found | _animated(json, path)
    return found


def _colour_changed(json: Column) -> Column:
    """An RGB matrix that isn't the identity's pattern, an HSL band off zero, or a curve that isn't the diagonal."""
    part = lambda name, kind: F.from_json(F.get_json_object(json, f"$.advanced.color.{name}"), kind)
    matrix = F.transform(part("rgbMatrix", "array<double>"), lambda x, i: x != F.when(i % 4 == 0, 1.0).otherwise(0.0))
    bands = F.map_values(part("hsl", "map<string,struct<hue:double,saturation:double,lightness:double>>"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)) != 0
    curves = F.map_values(part("curves", "map<string,array<struct<x:double,y:double>>>"))
    straight = lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0))["x"] == 0) & (F.get(p, F.lit(0))["y"] == 0) & (F.get(p, F.lit(1))["x"] == 1) & (F.get(p, F.lit(1))["y"] == 1)
    return _yes(F.exists(matrix, lambda x: x)) | _yes(F.exists(bands, lambda b: zero(b["hue"]) | zero(b["saturation"]) | zero(b["lightness"]))) | _yes(F.exists(curves, lambda p: ~_yes(straight(p))))


def _tracks_incomplete(json: Column, text: Column) -> Column:
    """No keyframe track at all, or one without keyframes."""
    part = lambda name: F.coalesce(F.map_values(F.from_json(F.get_json_object(json, f"$.advanced.{name}"), "map<string,struct<keyframes:array<string>>>")), F.array().cast("array<struct<keyframes:array<string>>>"))
    opacity = F.get_json_object(json, "$.advanced.opacity")
    one = F.when(opacity.isNotNull(), F.array(F.from_json(opacity, "keyframes array<string>"))).otherwise(F.array().cast("array<struct<keyframes:array<string>>>"))
    tracks = F.concat(part("transform"), F.when(text, F.array().cast("array<struct<keyframes:array<string>>>")).otherwise(part("crop")), one)
    return (F.size(tracks) == 0) | F.exists(tracks, lambda t: F.coalesce(F.size(t["keyframes"]), F.lit(0)) <= 0)


def rules(json: Column, item_type: Column) -> list[tuple[Column, str]]:
    """(condition, message) in their order."""
    text, video, audio, visual = item_type == "text", item_type == "video", item_type == "audio", item_type.isin(*VISUAL)
    advanced = _truthy(json, "$.advanced")
    preset = F.when(video, property_text(json, "filters.builtIn")).otherwise(property_text(json, "filters.filterType"))
    known = ["", "None", "Cool", *PRESETS]
    style_animated = _animated(json, "filters.builtIn") & video | _animated(json, "filters.filterType") & ~video
    for path in STATIC_STYLE:
        style_animated = style_animated | _animated(json, path)
    loud = _differs(json, {"audioSettings.balance": 0}) | _other(json, "audioSettings.eq", "Flat")
    for name in VIDEO_SOUND:
        loud = loud | _set(json, f"audioSettings.{name}")
    pitch = _yes(property_text(json, "speedSettings.pitchCorrection") == "false")
    style_move = F.get_json_object(json, "$.style.animType")
    return [
        *((advanced & _truthy(json, f"$.advanced.{key}"), label) for key, label in ADVANCED_BLOCKS),
        (advanced & _colour_changed(json), "Color processing"),
        (advanced & (_truthy(json, "$.advanced.transform.anchorX") | _truthy(json, "$.advanced.transform.anchorY")), "Anchor animation"),
        (advanced & text & _truthy(json, "$.advanced.crop"), "Crop animation"),
        (advanced & _tracks_incomplete(json, text), "Advanced state without keyframes"),
        (_truthy(json, "$.properties.effects"), "an item effect"),
        (style_animated, "animated color or filter controls"),
        (visual & (_yes(~preset.isin(known)) | _yes(~property_text(json, "filters.lutLibrary").isin(known))), "an unsupported filter"),
        (visual & _differs(json, TONAL, True), "tonal detail controls"),
        (visual & _differs(json, GRAIN, True), "vignette or grain"),
        (visual & (_other(json, "mask.shape", "None") | _other(json, "mask.maskType", "None") | _differs(json, MASK) | _set(json, "mask.invert")), "a mask"),
        (visual & (_set(json, "speedSettings.reverse") | _other(json, "speedSettings.speedCurve", "Linear") | pitch), "reverse, nonlinear speed, or pitch handling"),
        (visual & (_other(json, "animation.presets", "None") | _differs(json, MOVES)), "an entrance or exit animation"),
        (video & loud, "advanced audio processing"),
        (audio & (_set(json, "noiseReduction.enabled") | _other(json, "eq.preset", "Flat") | _differs(json, AUDIO_ITEM) | pitch), "advanced audio processing"),
        (text & (_other(json, "animation.preset", "None") | _yes(~style_move.isin("", "None"))), "an entrance or exit animation"),
    ]


def unsupported_state(json: Column, item_type: Column) -> Column:
    """The message of the first rule that an item breaks, or null."""
    return F.coalesce(*(F.when(condition, message) for condition, message in rules(json, item_type)))


def document_error(document: Column) -> Column:
    """Transitions, or effects that aren't switched off, stop a whole document."""
    effects = F.from_json(F.get_json_object(document, "$.effects"), "array<struct<enabled:boolean>>")
    return F.when(_truthy(document, "$.transitions"), "transitions").when(_yes(F.exists(effects, lambda e: F.coalesce(e["enabled"], F.lit(True)))), "effects")
