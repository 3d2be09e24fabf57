"""Fixed values of the text codecs: token pattern, characters and cue words of languages, vocabulary seed."""

# Latin words with one inner hyphen or apostrophe, runs of Chinese, Hangul or digits, single marks.
TOKEN = "[A-Za-zÀ-ỹ]+(?:[-'][A-Za-zÀ-ỹ]+)?|[一-鿿]+|[가-힯]+|[0-9]+|[^\\p{L}\\p{N}_\\s]"

VIETNAMESE = "ăâêôơưđĂÂÊÔƠƯĐáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
FRENCH = "éèêëàâîïôùûçÉÈÊËÀÂÎÏÔÙÛÇ"
FRENCH_CUES = ["la", "le", "les", "des", "du", "une", "un", "de", "données", "numériques", "technologie", "stockage", "préserver", "peut", "avec", "pour", "dans"]
ENGLISH_CUES = ["the", "a", "an", "is", "are", "and", "or", "of", "to", "in", "for", "with", "text", "data", "storage", "technology", "digital", "errors", "sports", "people", "games", "risk", "dangerous", "money", "players"]

EXTRA = [
    "[PAD]", "[UNK]",
    "the", "a", "an", "is", "are", "and", "or", "of", "to", "in", "for", "with", "as", "by", "from",
    "text", "data", "storage", "DNA", "technology", "digital", "preservation", "semantic", "structure",
    "repeated", "words", "contextual", "redundancy", "compressed", "binary", "stream", "token", "tokens", "IDs",
    "substitution", "errors", "occur", "decoded", "openable", "wrong", "promising", "long-term", "different",
    "valid", "may", "become", "some", "although", "model", "language", "context", "repair", "candidate",
    "people", "sports", "games", "dangerous", "risk", "risks", "participate", "participation", "players", "money",
    "professional", "training", "protection", "equipment", "popular", "factor", "allowed", "human", "compete", "safety",
    "Công", "nghệ", "lưu", "trữ", "có", "thể", "hữu", "ích", "cho", "bảo", "quản", "dữ", "liệu", "lâu", "dài",
    "văn", "bản", "cấu", "trúc", "ngữ", "nghĩa", "nhiều", "từ", "lặp", "lại",
    "La", "Le", "Les", "la", "le", "les", "technologie", "de", "stockage", "ADN", "peut", "préserver", "données", "numériques",
    "数据存储", "长期保存", "非常重要", "数据", "存储", "长期", "保存", "重要",
    "저장", "기술", "디지털", "정보", "장기간", "보존", "데이터", "있습니다",
]
