"""Fixed values.

Everything in this module is a constant whose exact value decides a result:
word lists, extension sets, patterns and thresholds.  Nothing here is logic.
"""

# --- fixed values: file extensions, one set per use -------------------------
AUDIO_EXT_ASSEMBLY = (
    "flac", "mp3", "m4a", "aac", "ogg", "opus", "wav", "ape",
    "wv", "alac", "aiff", "aif", "wma", "dsf", "dff", "mpc",
)
AUDIO_EXT_HARVEST = (
    "flac", "ape", "wv", "wav", "mp3", "m4a", "ogg", "opus", "aac", "alac",
)
AUDIO_EXT_DOWNLOADS = (
    "flac", "ape", "wv", "wav", "aiff", "aif", "m4a", "m4b", "alac",
    "mp3", "ogg", "opus", "oga", "wma", "dsf", "dff", "tak", "tta", "shn",
)
VIDEO_EXT_DOWNLOADS = (
    "mkv", "mp4", "avi", "m4v", "mov", "wmv", "mpg", "mpeg",
    "ts", "m2ts", "iso", "vob", "flv", "webm", "divx", "ogm",
)
VIDEO_EXT_BUNDLES = (
    "mkv", "mp4", "m4v", "avi", "wmv", "mov", "flv", "mpg", "mpeg",
    "mpe", "m2ts", "mts", "ts", "vob", "divx", "ogv", "webm", "3gp",
    "rm", "rmvb", "asf",
)
LOSSLESS_EXT = ("flac", "wav", "ape", "wv", "aiff", "aif", "alac", "dsf", "dff")

# --- fixed values: title noise ----------------------------------------------
TITLE_ABBREVIATIONS = (
    ("pts", "parts"), ("pt", "part"), ("vols", "volumes"), ("vol", "volume"),
)
EDITION_WORDS = (
    "the", "and", "a", "an", "deluxe", "expanded", "remaster", "remastered",
    "remasters", "remaster's", "edition", "editions", "anniversary", "bonus",
    "disc", "discs", "cd", "cds", "mono", "stereo", "version", "versions",
    "reissue", "reissued", "collectors", "collector", "special", "limited",
    "digital", "hd", "hires", "hi", "res", "sacd", "hdcd", "mfsl", "dsd",
    "flac", "mp3", "kbps", "vbr", "bit", "24bit", "16bit", "24", "16",
)
IDENTITY_NOISE = (
    "a", "an", "and", "the", "of", "on", "in", "at", "to", "for", "with",
    "by", "or", "from", "de", "le", "la", "les", "el",
    "flac", "ape", "wav", "wavpack", "wv", "alac", "mp3", "aac", "m4a",
    "ogg", "opus", "lossless", "dsd",
    "cd", "cds", "disc", "discs", "disk", "cdrip", "rip", "vinyl", "lp",
    "ep", "box", "boxset", "set",
    "remaster", "remastered", "reissue", "edition", "deluxe", "expanded",
    "anniversary", "bit", "kbps", "khz", "vbr", "v0", "v2", "320", "256",
    "192", "128", "24", "16", "96", "44", "48", "192khz",
    "web", "webrip", "scene", "proper", "repack", "retail", "promo", "va",
    "various",
)

# --- fixed values: artist credits -------------------------------------------
CREDIT_CUTS = ("feat", "featuring", "ft", "with", "presents", "pres", "vs")
CREDIT_NOISE = (
    "dj", "mc", "vj", "the", "a", "an", "of", "feat", "feats", "featuring",
    "ft", "with", "vs", "presents", "pres",
)

# --- fixed values: Cyrillic to Latin ----------------------------------------
CYRILLIC_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh",
    "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a",
    "ь": "y", "ю": "yu", "я": "ya", "ы": "y", "э": "e", "ё": "yo",
    "є": "ye", "і": "i", "ї": "yi", "ґ": "g", "ј": "j", "љ": "lj",
    "њ": "nj", "ћ": "c", "ђ": "dj", "џ": "dz", "ѕ": "dz", "ѓ": "g",
    "ќ": "k", "ѐ": "e", "ѝ": "i", "ѣ": "e",
}

# --- fixed values: folder names ----------------------------------------------
STRUCTURAL_FOLDERS = (
    "audio", "music", "_processed", "_unmatched", "torrents", "scans",
    "artwork",
)

# --- fixed values: release types ---------------------------------------------
NON_STUDIO_TYPES = (
    "compilation", "live", "remix", "dj-mix", "mixtape/street", "demo",
    "interview", "spokenword", "audiobook", "audio drama", "soundtrack",
)
COLLECTION_TYPES = ("compilation", "soundtrack", "live")

# --- fixed values: text sheet decoding order ----------------------------------
SHEET_ENCODINGS = (
    "utf-8-sig", "utf-8", "cp1251", "cp1252", "shift_jis", "gb18030",
    "iso-8859-1",
)
FRAMES_PER_SECOND = 75

# --- fixed values: wrapper keys a model may put around a list ----------------
ANSWER_WRAPPERS = (
    "tracks", "items", "data", "result", "results", "tags", "array", "list",
    "output",
)

# --- fixed values: transfer states ---------------------------------------------
DEAD_STATES = (
    "metadl", "forcedmetadl", "stalleddl", "stalledup", "forcedup",
    "queueddl", "missingfiles", "error", "unknown",
)
DOWNLOADING_STATES = ("downloading", "forceddl", "dl")

# --- fixed values: thresholds and limits -------------------------------------
DURATION_TOLERANCE_MS = 10_000
AUTHORITY_TOLERANCE_MS = 15_000
FUZZY_MIN = 0.90
FUZZY_MARGIN = 0.05
FUZZY_MIN_LENGTH = 6
PLAN_MIN_SCORE = 0.87
ARTIST_AGREE_MIN = 0.90
ARTIST_BONUS = 0.05
COVERAGE_ACCEPT = 0.60
COVERAGE_REJECT = 0.25
SHELL_MAX_BYTES = 100 * 1024 * 1024
DEAD_GRACE_S = 172_800
STALLED_GRACE_S = 259_200
REASON_MAX_CHARS = 500

# --- fixed values: patterns ----------------------------------------------------
ANY_BRACKETS = r"[\(\[\{][^\)\]\}]*[\)\]\}]"
ROUND_SQUARE = r"[\(\[][^)\]]*[\)\]]"
PAIRED_ROUND_SQUARE = r"\(.*?\)|\[.*?\]"
PAIRED_ALL = r"\(.*?\)|\[.*?\]|\{.*?\}"
FEATURE_CLAUSE = r"\s*(?:feat\.?|featuring|ft\.?|with)\s+.*$"
NOISE_TAIL = r"\s*[-–—]?\s*(?:remaster(?:ed)?(?:\s*\d{4})?|\d{4}\s*remaster|radio\s*edit|album\s*version|single\s*version|mono|stereo|live|explicit|clean|bonus\s*track|remix|edit|version)\s*$"
#: what a text that NOISE_TAIL meets ends in, before white space
NOISE_TAIL_ENDS = r"remaster(?:ed)?|\d{4}|edit|version|mono|stereo|live|explicit|clean|track|remix"
LEAD_TRACK = r"(?i)^\s*(?:cd\s*\d+\s*[-_. ]*)?(?:\d{1,2}\s*[-_.]\s*)?(?:[a-d]?\d{1,3})\s*[-_.)\]]+\s*"
TRAIL_DISC = r"(?i)[\s\-_.]*(?:cd|disc|disk)\s*\d{1,2}\s*$"
DASHES = r"[\x{2010}-\x{2015}]"
SEARCH_PUNCT = r"[^\p{L}\p{N}_\s&'-]"
TRAIL_YEARS = r"[\s,-]*\b(1[89]\d\d|20\d\d)\s*(?:-\s*(?:1[89]\d\d|20\d\d|\d\d))?\s*$"
SUBTITLE = r"\s*[:;]\s*|\s+-\s+"
LEAD_NUMBER = r"^\s*\d+\s*[.\-]\s*"
LEAD_YEARS = r"^\s*(?:19|20)\d{2}(?:\s*,\s*(?:19|20)\d{2})*[\s.\-]+"
ARTIST_YEAR_ALBUM = r"(?i)^.*?\s-\s*(?:19|20)\d{2}\s*[-.]\s*(.+)$"
ANY_YEAR = r"\b(19|20)\d{2}\b"
LONE_YEAR = r"(?:^|[^0-9])((?:19|20)\d{2})(?:[^0-9]|$)"
STAGE_PREFIX = r"(?i)^\s*(?:dj|mc|vj|dr)[\s.\-_]+"
BAD_FILE_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
MAGNET_HASH = r"(?i)\bxt=urn:btih:([0-9a-f]{40}|[2-7a-z]{32})\b"
BARE_HASH = r"^(?:[0-9a-f]{40}|[2-7a-z]{32})$"
LEAF_FOLDER = r"(?i)^(?:cd|disc|disk|dvd|side)\s*[.\-_]?\s*\d{1,3}\b|^\d{1,2}$|^-?(?:scans?|artwork|art|covers?|cover|sleeves?|booklet|images?|thumbs?|logs?|info)$|^-?(?:bonus(?:[\s._-]*(?:disc|cd|dvd|tracks?|material|cuts?))?|extras?|bonuses)$"
HONORIFIC = r"^\s*(?:ms|mrs|miss|mr)\.?\s+(\S)"
FOLDER_ARTIST_NOISE = r"(?i)\b(?:discography|complete|collection|studio albums?|flac|mp3|kbps|vbr)\b"
VARIANT_MARK = r"(?U)\b(take\s*\d+|alt(?:ernate|\.)?(?:\s+take)?|live|instrumental|remix|rehearsal|demo|karaoke|acappella|a\s*cappella|reprise|radio\s+edit|edit|mono|stereo\s+version|interview)\b"
DISC_WORD = r"^(?:cd|disc|disk)$"
DISC_NUMBERED = r"^(?:cd|disc|disk)\d+$"
NOISE_FOLDER = r"(?i)^-?(?:bootlegs?|live|lives|other|others|singles?|compilations?|comps?|collaborations?|collabs?|remix(?:es)?|demos?|unofficial|misc|rarit(?:y|ies)|b-?sides?|extras?|mixes|promos?|eps?|antholog(?:y|ies)|collections?|box\s*sets?|greatest\s*hits|best\s*of|essentials?|definitive)$"
UNOFFICIAL = r"(?i)(?:^|[\s\-_.\(\[])(?:greatest\s+hits|best\s+of|the\s+very\s+best|very\s+best\s+of|antholog(?:y|ies)|compilations?|collections?|box\s*sets?|sampler|essential|definitive|singles\s+collection|hits\s+collection|remix(?:es|ed)?|megamix|dj[\s\-_.]*mix|mixtape|karaoke|tribute|bootleg|rarities|b[\s\-_.]*sides|outtakes|unreleased|live\s+(?:at|in|from|on)\b|in\s+concert|unplugged|live\s+albums?|live\s+recordings?|live\s+bootleg)(?:$|[\s\-_.\)\]0-9])"
VIDEO_ZONE = r"(?:^|/)(?:video_ts|bdmv)(?:/|$)"
AUDIO_ZONE = r"(?:^|/)audio_ts(?:/|$)"
