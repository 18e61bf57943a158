"""Word lists, patterns, weights and formats that results depend on."""

EVENT_TYPES = ("speech", "ocr", "code", "visual", "scene", "terminal", "slide", "ui", "url", "command", "equation", "artifact")

# Light code heuristic: patterns of which two must occur.
LIGHT_CODE_PATTERNS = (
    r"\b(def|class|import|from|return|for|while|if|else|elif)\b",
    r"\b(public|private|protected|static|void|int|String|boolean|class)\b",
    r"\b(const|let|var|function|async|await|console\.log)\b",
    r'#include\s*[<"]',
    r"=>",
    r"[{};]",
    r"\b[a-zA-Z_][a-zA-Z0-9_]*\([^)]*\)",
    r"\b[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*",
)

# Programming languages in tie order: pattern and weight of one hit.
LANGUAGE_PATTERNS = {
    "python": (
        (r"\bdef\s+\w+\s*\(", 3.0), (r"\bclass\s+\w+.*:", 3.0), (r"\bimport\s+\w+", 2.0), (r"\bfrom\s+\w+\s+import\b", 3.0),
        (r"\bself\.\w+", 2.5), (r"\bif\s+__name__\s*==", 4.0), (r"\belif\b", 2.0), (r"\bprint\s*\(", 1.5),
        (r"\basync\s+def\b", 3.0), (r"\bawait\s+\w+", 2.0), (r"^\s*@\w+", 1.5), (r"\blambda\s+", 2.0), (r":\s*$", 0.5),
    ),
    "javascript": (
        (r"\bconst\s+\w+\s*=", 2.5), (r"\blet\s+\w+\s*=", 2.0), (r"\bvar\s+\w+\s*=", 1.5), (r"\bfunction\s+\w+\s*\(", 2.5),
        (r"=>\s*[{(]?", 2.0), (r"\bconsole\.\w+\(", 3.0), (r"\bdocument\.\w+", 2.5), (r"\brequire\s*\(", 2.0),
        (r"\bmodule\.exports\b", 3.0), (r"\basync\s+function\b", 2.5),
    ),
    "typescript": (
        (r":\s*(string|number|boolean|void|any)\b", 3.0), (r"\binterface\s+\w+", 3.5), (r"\btype\s+\w+\s*=", 3.0),
        (r"<\w+>", 1.0), (r"\benum\s+\w+", 2.5),
    ),
    "java": (
        (r"\bpublic\s+(static\s+)?(?:void|int|String|boolean|class)\b", 3.5), (r"\bprivate\s+\w+", 2.0), (r"\bprotected\s+\w+", 2.0),
        (r"\bSystem\.out\.print", 3.5), (r"\bnew\s+\w+\(", 1.5), (r"\b(extends|implements)\s+\w+", 2.5), (r"@Override", 3.0), (r"@Autowired", 3.0),
    ),
    "cpp": (
        (r"#include\s*[<\"]", 4.0), (r"\bstd::\w+", 3.5), (r"\bcout\s*<<", 3.0), (r"\bcin\s*>>", 3.0), (r"\bnamespace\s+\w+", 2.5),
        (r"\btemplate\s*<", 3.0), (r"\bvirtual\s+\w+", 2.0), (r"::\w+\(", 1.5),
    ),
    "go": (
        (r"\bfunc\s+\w+\(", 3.0), (r"\bpackage\s+\w+", 3.5), (r"\bfmt\.\w+", 3.0), (r":=", 2.0), (r"\bgoroutine\b", 3.0),
        (r"\bchan\s+\w+", 2.5), (r"\bdefer\s+", 2.0),
    ),
    "rust": (
        (r"\bfn\s+\w+\(", 3.0), (r"\blet\s+mut\s+", 3.5), (r"\bimpl\s+\w+", 3.0), (r"\bpub\s+fn\b", 3.0), (r"\bmatch\s+\w+\s*\{", 2.5),
        (r"->", 1.0), (r"\bprintln!\(", 4.0),
    ),
    "sql": (
        (r"\bSELECT\b.*\bFROM\b", 4.0), (r"\bCREATE\s+TABLE\b", 4.0), (r"\bINSERT\s+INTO\b", 3.5), (r"\bALTER\s+TABLE\b", 3.5),
        (r"\bWHERE\b", 1.5), (r"\bJOIN\b", 1.5), (r"\bGROUP\s+BY\b", 2.0),
    ),
    "shell": (
        (r"^\s*#!/bin/(ba)?sh", 5.0), (r"\becho\s+", 1.5), (r"\bsudo\s+", 2.0), (r"\bpip\s+install\b", 2.5), (r"\bnpm\s+(install|run)\b", 2.5),
        (r"\bgit\s+(clone|commit|push)\b", 2.5), (r"\$\{?\w+\}?", 1.5),
    ),
    "html": ((r"<\w+[^>]*>", 1.5), (r"</\w+>", 1.5), (r'class="[^"]*"', 2.0), (r"<!DOCTYPE", 4.0)),
    "css": ((r"\w+\s*:\s*\w+.*;", 1.5), (r"\.\w+\s*\{", 2.0), (r"#\w+\s*\{", 2.0), (r"@media\b", 3.0)),
}
LANGUAGE_THRESHOLD = 4.0

# Code blocks: pattern and weight, each counted five times at most.
BLOCK_INDICATORS = (
    (r"[{};]", 1.0), (r"\b\w+\([^)]*\)", 1.0), (r"\b\w+\s*=\s*", 0.8), (r"^\s*(const|let|var|def|class|function|import|from)\b", 1.0),
    (r"^\s{2,}\S", 0.5), (r"//.*$", 1.5), (r"/\*.*\*/", 1.5), (r"#\s*\w+", 0.5), (r"\b(true|false|null|None|undefined)\b", 1.0),
    (r"\b\d+\.\d+\b", 0.3), (r'["\'][\w./]+["\']', 0.5),
)
BLOCK_THRESHOLD = 2.0

# One line of code: any of these, whatever the case.
LINE_INDICATORS = (
    r"[{};]$",
    r"^\s*(def|class|import|from|return|if|else|for|while)\b",
    r"^\s*(const|let|var|function|public|private)\b",
    r"^\s*#include\b",
    r"=>",
    r"\w+\([^)]*\)\s*[{;:]?\s*$",
    r"^\s*\w+\s*=\s*",
    r"^\s*//",
    r"^\s*#\s",
)

# Spoken languages: aliases (None: decide by sound) and names.
LANGUAGE_ALIASES = {
    "auto": None, "hi": "hi", "hindi": "hi", "gu": "gu", "gujarati": "gu", "gujrati": "gu", "mr": "mr", "marathi": "mr", "kn": "kn", "kannada": "kn",
    "sa": "sa", "sanskrit": "sa", "en": "en", "english": "en", "bn": "bn", "bengali": "bn", "as": "as", "assamese": "as", "pa": "pa", "punjabi": "pa",
    "ta": "ta", "tamil": "ta", "te": "te", "telugu": "te", "ml": "ml", "malayalam": "ml", "ur": "ur", "urdu": "ur", "ne": "ne", "nepali": "ne",
    "prakrit": None, "prākrit": None, "pali-prakrit": None,
}
LANGUAGE_NAMES = {
    "hi": "Hindi", "gu": "Gujarati", "mr": "Marathi", "kn": "Kannada", "sa": "Sanskrit", "en": "English", "bn": "Bengali", "as": "Assamese",
    "pa": "Punjabi", "ta": "Tamil", "te": "Telugu", "ml": "Malayalam", "ur": "Urdu", "ne": "Nepali",
}

# Hosts a video address may have.
VIDEO_HOSTS = (
    "youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be", "youtube-nocookie.com", "www.youtube-nocookie.com",
)
WATCH_URL = "https://www.youtube.com/watch?v="

VIDEO_SUFFIXES = (".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v", ".ts", ".mts", ".m2ts")
STAGES = ("metadata", "transcription", "ocr", "fusion", "output")
IMAGE_VARIANTS = ("clahe", "sharpen", "threshold")

# White space as Python's \s and strip() see it.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
