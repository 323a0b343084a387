"""Dimensions: languages, voices, model sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and codes of the languages, in order.
LANGUAGES = [
    ("Auto Detect", "auto"), ("English", "en"), ("Spanish", "es"), ("French", "fr"), ("German", "de"), ("Italian", "it"),
    ("Portuguese", "pt"), ("Polish", "pl"), ("Turkish", "tr"), ("Russian", "ru"), ("Dutch", "nl"), ("Czech", "cs"), ("Arabic", "ar"),
    ("Chinese (Simplified)", "zh"), ("Chinese", "zh"), ("Japanese", "ja"), ("Korean", "ko"), ("Hindi", "hi"),
]
# Voices by language and gender.
VOICES = {
    "en": (["en-US-AriaNeural", "en-US-JennyNeural", "en-GB-SoniaNeural"], ["en-US-GuyNeural", "en-US-ChristopherNeural", "en-GB-RyanNeural"]),
    "es": (["es-ES-ElviraNeural", "es-MX-DaliaNeural"], ["es-ES-AlvaroNeural", "es-MX-JorgeNeural"]),
    "fr": (["fr-FR-DeniseNeural", "fr-CA-SylvieNeural"], ["fr-FR-HenriNeural", "fr-CA-JeanNeural"]),
    "de": (["de-DE-KatjaNeural", "de-AT-IngridNeural"], ["de-DE-ConradNeural", "de-AT-JonasNeural"]),
    "it": (["it-IT-ElsaNeural", "it-IT-IsabellaNeural"], ["it-IT-DiegoNeural", "it-IT-GiuseppeNeural"]),
    "pt": (["pt-BR-FranciscaNeural", "pt-PT-RaquelNeural"], ["pt-BR-AntonioNeural", "pt-PT-DuarteNeural"]),
    "pl": (["pl-PL-ZofiaNeural", "pl-PL-AgnieszkaNeural"], ["pl-PL-MarekNeural"]),
    "tr": (["tr-TR-EmelNeural"], ["tr-TR-AhmetNeural"]),
    "ru": (["ru-RU-SvetlanaNeural", "ru-RU-DariyaNeural"], ["ru-RU-DmitryNeural"]),
    "nl": (["nl-NL-ColetteNeural", "nl-NL-FennaNeural"], ["nl-NL-MaartenNeural"]),
    "cs": (["cs-CZ-VlastaNeural"], ["cs-CZ-AntoninNeural"]),
    "ar": (["ar-SA-ZariyahNeural", "ar-EG-SalmaNeural"], ["ar-SA-HamedNeural", "ar-EG-ShakirNeural"]),
    "zh": (["zh-CN-XiaoxiaoNeural", "zh-CN-XiaoyiNeural", "zh-CN-XiaochenNeural"], ["zh-CN-YunxiNeural", "zh-CN-YunjianNeural", "zh-CN-YunyeNeural"]),
    "ja": (["ja-JP-NanamiNeural", "ja-JP-AoiNeural"], ["ja-JP-KeitaNeural", "ja-JP-DaichiNeural"]),
    "ko": (["ko-KR-SunHiNeural", "ko-KR-JiMinNeural"], ["ko-KR-InJoonNeural", "ko-KR-BongJinNeural"]),
    "hi": (["hi-IN-SwaraNeural"], ["hi-IN-MadhurNeural"]),
}
# Names of model sizes.
MODEL_SIZES = {
    "large-v3": "large-v3", "large-v3-turbo": "large-v3-turbo", "medium": "medium", "base": "base", "small": "small",
    "Large v3": "large-v3", "Large v3 Turbo (Fast)": "large-v3-turbo", "Medium": "medium", "Base": "base", "Small": "small",
}
# What an accelerator error's message or type contains.
ACCELERATOR_ERRORS = ["cuda", "gpu", "out of memory", "oom", "cudnn", "cublas", "illegal memory", "device-side assert", "cusparse", "cufft", "nccl", "nvrtc", "curand"]
# Codes of the OCR engines.
OCR_CODES = {"en": "en", "ar": "ar", "zh": "ch", "fr": "fr", "de": "german", "es": "es", "it": "it", "ja": "japan", "ko": "korean", "ru": "ru", "pt": "pt"}


def lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def language_code(name: Column) -> Column:
    """A code as it is, a name's code, else en."""
    return F.when(name.isin(sorted({c for _, c in LANGUAGES})), name).otherwise(F.coalesce(lookup(dict(LANGUAGES), name), F.lit("en")))


def language_name(code: Column) -> Column:
    """The first name of a code, else English."""
    return F.coalesce(lookup({c: n for n, c in reversed(LANGUAGES)}, code), F.lit("English"))


def available_voices(code: Column) -> Column:
    """The network backend's voices of a language, sorted; an empty array if there are none."""
    pairs = [x for c, (f, m) in VOICES.items() for x in (F.lit(c), F.array(*map(F.lit, sorted(f + m))))]
    return F.coalesce(F.create_map(*pairs)[code], F.array().cast("array<string>"))


def gender_voices(code: Column, gender: Column) -> Column:
    """Voices of a language (else of English) and gender (else female)."""
    tables = [F.create_map(*[x for c, v in VOICES.items() for x in (F.lit(c), F.array(*map(F.lit, v[k])))]) for k in (0, 1)]
    known = F.when(code.isin(list(VOICES)), code).otherwise("en")
    return F.when(gender == "Male", tables[1][known]).otherwise(tables[0][known])


def model_size(name: Column, current: Column) -> Column:
    return F.coalesce(lookup(MODEL_SIZES, name), name, current)


def is_accelerator_error(message: Column, kind: Column) -> Column:
    pattern = "|".join(ACCELERATOR_ERRORS)
    return F.lower(message).rlike(pattern) | F.lower(kind).rlike(pattern)


def ocr_code(code: Column) -> Column:
    return F.coalesce(lookup(OCR_CODES, code), F.lit("en"))


# The offline synthesis models by language.
OFFLINE_VOICES = {"en": "en_US-lessac-high", "es": "es_ES-sharvard-medium", "fr": "fr_FR-siwis-medium", "de": "de_DE-thorsten-medium", "it": "it_IT-riccardo-x_low"}
# What cloning backends offer, and the speakers of the long-form one.
CLONING = "Cloning (Reference Audio)"
LONG_FORM_SPEAKERS = ["Alice", "Bob", "Carol", "Dave", "Frank"]
# Fonts, the first that can be loaded is taken.
FONTS = ["arial.ttf", "segoeui.ttf", "tahoma.ttf", "msgothic.ttc"]
LANGUAGE_FONTS = {"ja": ["msgothic.ttc", "meiryo.ttc", "yugothic.ttc"], "zh": ["simsun.ttc", "msyh.ttc", "simhei.ttf"], "ko": ["malgun.ttf", "gulim.ttc"]}


def voices_of(model: Column, code: Column) -> Column:
    """What a synthesis backend offers for a language; an empty array if nothing."""
    none = F.array().cast("array<string>")
    offline = lookup(OFFLINE_VOICES, code)
    return (
        F.when(model == "edge", available_voices(code)).when(model == "piper", F.when(offline.isNotNull(), F.array(offline)).otherwise(none))
        .when(model.isin("xtts", "f5"), F.array(F.lit(CLONING))).when(model.contains("vibevoice"), F.array(*map(F.lit, LONG_FORM_SPEAKERS))).otherwise(none)
    )


def offline_voice(code: Column) -> Column:
    """The offline model that speaks a language; other languages are spoken by the English one."""
    return F.coalesce(lookup(OFFLINE_VOICES, code), F.lit(OFFLINE_VOICES["en"]))


def chosen_voice(code: Column, gender: Column, speaker: Column, preferred: Column | None = None, selected: Column | None = None) -> Column:
    """The voice of a segment: the preferred one unless that is Auto, else the selector's, else by the number at the end of
    the speaker's name, else the first of its language and gender."""
    voices = gender_voices(code, gender)
    number = F.element_at(F.split(speaker, "_"), -1).try_cast("int")
    by_number = F.coalesce(F.get(voices, F.pmod(number, F.size(voices))), F.get(voices, F.lit(0)))
    if selected is not None:
        by_number = F.when(speaker.isNotNull(), F.coalesce(selected, by_number)).otherwise(by_number)
    return F.when((preferred != "") & (preferred != "Auto"), preferred).otherwise(by_number) if preferred is not None else by_number


def font(code: Column, available: Column) -> Column:
    """The first font of a language that is available, else the first of the common ones, else that they begin with."""
    first = lambda names: F.get(F.filter(names, lambda f: F.array_contains(available, f)), F.lit(0))
    own = F.create_map(*[x for c, names in LANGUAGE_FONTS.items() for x in (F.lit(c), F.array(*map(F.lit, names)))])[code]
    return F.coalesce(first(own), first(F.array(*map(F.lit, FONTS))), F.lit(FONTS[0]))
