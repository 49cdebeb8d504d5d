"""Word lists, limits, patterns and codes that results depend on.

Everything here is stated as data.  Patterns are written for Java regular
expressions (the dialect of ``rlike`` / ``regexp_extract``).
"""

# Suffixes of archives and of page images (compared in lower case).
ARCHIVE_SUFFIXES = [".cbz", ".zip"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif", ".bmp", ".tif", ".tiff"]

# Name of the metadata document and of its root element.
METADATA_NAME = "ComicInfo.xml"
METADATA_ROOT = "ComicInfo"

# Safety limits.
MAX_ARCHIVE_MEMBERS = 100_000
MAX_ARCHIVE_BYTES = 8 * 1024 * 1024 * 1024
MAX_MEMBER_RATIO = 1_000
MAX_METADATA_BYTES = {"validate": 8 * 1024 * 1024, "transform": 16 * 1024 * 1024}
DEFAULT_DISTANCE = 4
MAX_DISTANCE = 16

# White space in the sense of Unicode's property, as the inside of a character class.
WHITE_SPACE = "\\t-\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

# Patterns.
SHA256_PATTERN = r"^[0-9a-fA-F]{64}$"
DRIVE_PATTERN = r"^[A-Za-z]:"
CHAPTER_PATTERN = r"(?i)(?:^|[\s._-])ch(?:apter)?[\s._-]*([0-9]+(?:\.[0-9]+)?)"
VOLUME_PATTERN = r"(?i)(?:^|[\s._-])vol(?:ume)?[\s._-]*[0-9]+|(?:^|[\s._-])v[0-9]+"
VOLUME_VALUE_PATTERN = r"(?i)(?:^|[\s._-])(?:vol(?:ume)?|v)[\s._-]*([0-9]+(?:\.[0-9]+)?)"
SPLIT_VOLUME_PATTERN = r"(?i)\bvol(?:ume)?\.?\s*\d+"
SPECIAL_PATTERN = r"(?i)^SP[\s._-]*([0-9]+(?:\.[0-9]+)?)$"
SPECIAL_NAME_PATTERN = r"(?i)(?:^|[\s._-])SP[\s._-]*([0-9]+(?:\.[0-9]+)?)"
SPECIAL_NUMBER_PATTERN = r"(?i)^SP[0-9]+$"
SPAN_PATTERN = r"^\s*(\d+)\s*(?:\.\.|-|–)\s*(\d+)\s*$"
CHECKSUM_PATTERN = r"^([0-9a-fA-F]{64})[ \t]+\*?(.+)$"
REVIEW_KEY_PATTERN = r"^\d+:[1-9]\d*$"
HAN_PATTERN = r"[㐀-鿿]"
KANA_PATTERN = r"[぀-ヿ]"
FORBIDDEN_XML_PATTERN = r"(?i)<!\s*(?:DOCTYPE|ENTITY)\b"

# Identity policies.
POLICIES = ["continuous-chapter", "volume-aware-chapter", "volume-only"]
DEFAULT_POLICY = "continuous-chapter"

# Identity fields, in report order, and the ones a metadata refresh keeps.
IDENTITY_FIELDS = ["Title", "Series", "LocalizedSeries", "SeriesSort", "Number", "Volume", "Count", "Format"]
REFRESH_KEEPS = ["Series", "LocalizedSeries", "SeriesSort", "Volume", "Number", "Format"]
NORMALIZATION_MAY_CHANGE = ["Series", "LocalizedSeries", "SeriesSort", "Volume", "Number", "Format", "Title"]

# Words.
HIGH_CONFIDENCE_WORDS = ["high", "verified", "confirmed"]
COVERAGE_WORDS = ["complete", "exact", "exactly-once", "full", "passed", "pass", "true"]

# Alias lists: the first key with a non-empty value wins.
SERIES_KEYS = ["series", "Series", "series_name"]
POLICY_KEYS = ["identity_policy", "series_identity_policy"]
VOLUME_KEYS = ["volume", "Volume", "volume_number"]
CHAPTER_KEYS = ["chapter", "Number", "chapter_number"]
SPECIAL_NUMBER_KEYS = ["special", "number", "Number"]
RECORD_PATH_KEYS = [
    "relative_path", "output_path", "final_path", "target_path",
    "archive_path", "archive", "output", "path",
]
SOURCE_KEYS = ["source_file", "source_path", "source_pdf", "source"]
PAGE_COUNT_KEYS = ["source_page_count", "total_source_pages", "total_pages", "page_count"]
COVERAGE_KEYS = ["coverage_complete", "exact_coverage", "covered_exactly_once", "coverage_result"]
SPAN_KEY_PAIRS = [
    ("start_page", "end_page"), ("page_start", "page_end"),
    ("source_start", "source_end"), ("start", "end"),
]
SPAN_LIST_KEYS = ["ranges", "spans", "page_ranges", "covered_ranges", "coverage"]
GAP_KEYS = ["deliberate_missing_ranges", "intentional_gaps", "confirmed_source_gaps"]
GAP_REASON_KEYS = ["reason", "source_reason", "missing_source"]
GAP_CONFIRMED_KEYS = ["user_confirmation", "confirmed", "source_confirmed"]
GAP_START_KEYS = ["start", "from", "first", "start_chapter"]
GAP_END_KEYS = ["end", "to", "last", "end_chapter"]
GAP_NESTED_KEYS = ["chapter", "chapters", "numbers", "range", "missing"]
MANIFEST_ROOT_KEYS = ["root", "library", "base_path", "source_root", "formal_library"]
MANIFEST_PATH_KEYS = ["path", "relative_path", "source", "archive"]
MANIFEST_HASH_KEYS = ["sha256", "hash", "checksum"]
MANIFEST_DIGEST_KEYS = ["sha256", "hash", "checksum", "manifest_sha256", "tree_sha256"]
DECISION_SECTIONS = [
    "decisions", "resolved_decisions", "decision_resolution", "ocr_permissions",
    "ocr_review_conclusions", "chapter_boundaries", "primary_editions", "ignored_damaged_items",
    "special_deduplication", "visual_review", "locked_metadata",
]
CACHE_KEYS = ["disposable_caches", "reconstructable_caches", "cache_paths"]

# Run state: required groups and the names each may be stored under.
STATE_GROUPS = {
    "schema_version": ["schema_version"],
    "run_id": ["run_id"],
    "lifecycle_status": ["status", "lifecycle_status"],
    "current_stage": ["current_stage", "current_phase"],
    "source_directory": ["source_root", "source_path", "source"],
    "formal_output_directory": ["formal_library", "final_library", "formal_path"],
    "backup_directory": ["backup_directory", "backup_root"],
    "persistent_staging": ["staging_path", "staging", "candidate_library"],
    "last_complete_unit": ["last_complete_unit", "last_completed_atomic_unit"],
    "completed_archives": ["completed_archives"],
    "pending_archives": ["pending_archives"],
    "source_hashes": ["source_hashes", "source_manifest"],
    "formal_library_baseline": ["formal_library_baseline", "formal_library_hashes"],
    "chapter_boundaries": ["chapter_boundaries", "confirmed_chapter_boundaries"],
    "ocr_permissions": ["ocr_permissions", "ocr_authorization"],
    "ocr_review_conclusions": ["ocr_review_conclusions", "ocr_visual_review"],
    "primary_editions": ["primary_editions", "primary_selection"],
    "ignored_damaged_items": ["ignored_damaged_items", "user_ignored_damaged_items"],
    "special_deduplication": ["special_deduplication", "special_dedupe_conclusions"],
    "locked_metadata": ["locked_metadata"],
    "candidate_library_status": ["candidate_library_status", "current_candidate_library_state"],
    "profile": ["profile"],
    "identity_policy": ["identity_policy"],
    "tool_fingerprint": ["tool_fingerprint", "tool_versions"],
    "config_sha256": ["config_sha256"],
    "config_path": ["config_path"],
    "plan_sha256": ["plan_sha256"],
    "plan_path": ["plan_path"],
    "decision_log_sha256": ["decision_log_sha256", "decision_resolution_sha256"],
    "decision_log_path": ["decision_log_path", "decision_resolution_path"],
    "lock_owner": ["lock_owner"],
    "filesystem_capabilities": ["filesystem_capabilities"],
    "candidate_manifest": ["candidate_manifest", "candidate_archive_manifest"],
    "review_copy_hashes": ["review_copy_hashes", "review_hashes"],
    "unaffected_archive_hashes": ["unaffected_archive_hashes"],
    "affected_formal_archives": ["affected_formal_archives"],
}
STATE_STATUSES = [
    "inventory", "preflight", "building-candidate", "paused", "candidate-ready",
    "validated-candidate", "promotion-intent", "rollback-pending", "rollback-complete",
    "rollback-failed", "validated-final",
]

# Boundary evidence, best first.
EVIDENCE_ORDER = [
    "embedded-contents-bookmarks-metadata",
    "epub-opf-spine-ncx-navigation",
    "visible-contents-headings-structure",
    "filename-folder-comicinfo",
    "adjacent-sequence-volume-chapter-map",
    "reliable-external-sources",
    "user-authorized-ocr",
]

# Metadata sources, strongest first.
SOURCE_PRECEDENCE = ["locked", "existing", "volume", "series", "embedded", "inferred"]

# Match policy.
MATCH_THRESHOLD = 0.92
MATCH_MARGIN = 0.10

# Required-language fields (the summary has its own code).
CHINESE_FIELDS = ["Series", "LocalizedSeries", "SeriesSort", "Title", "Genre"]

# Tags.
TAG_VOCABULARY = {
    "cosplay": ["cosplay", "Cosplay"],
    "4-koma": ["4-koma", "4koma", "yonkoma"],
    "oneshot": ["oneshot", "one-shot"],
    "webtoon": ["webtoon"],
    "doujinshi": ["doujinshi", "doujin"],
    "artbook": ["artbook", "art-book"],
    "anthology": ["anthology"],
    "full-color": ["full-color", "full colour"],
    "monochrome": ["monochrome", "black-and-white"],
    "isekai": ["isekai"],
    "yuri": ["yuri"],
    "yaoi": ["yaoi"],
    "shounen": ["shounen"],
    "shoujo": ["shoujo"],
    "seinen": ["seinen"],
    "josei": ["josei"],
}
PROTECTED_TAGS = ["cosplay"]
RELEASE_TAGS = ["简中", "繁中", "汉化", "扫图"]

# Language and direction values.
LANGUAGE_CODES = {
    "simplified chinese": "zh-Hans",
    "traditional chinese": "zh-Hant",
    "japanese": "ja",
    "english": "en",
}
DIRECTION_CODES = {"japanese": "YesAndRightToLeft", "right-to-left": "YesAndRightToLeft"}

# Content signatures (hex prefix) and the suffixes they belong to.
SIGNATURES = [
    ("FFD8FF", [".jpg", ".jpeg"]),
    ("89504E470D0A1A0A", [".png"]),
    ("474946383761", [".gif"]),
    ("474946383961", [".gif"]),
    ("424D", [".bmp"]),
    ("49492A00", [".tif", ".tiff"]),
    ("4D4D002A", [".tif", ".tiff"]),
    ("52494646", [".webp"]),
    ("504B0304", [".cbz", ".zip"]),
]

# Issue codes: code -> (area, severity).  A severity of two words means that
# the weaker one applies unless policy escalates it.
ISSUE_CODES = {
    "PATH001": ("path", "BLOCKER"), "PATH002": ("path", "BLOCKER"),
    "PATH003": ("path", "WARNING/BLOCKER"), "PATH004": ("path", "WARNING"),
    "PATH005": ("path", "BLOCKER"), "PATH006": ("path", "BLOCKER"),
    "NAME001": ("naming", "BLOCKER"), "NAME002": ("naming", "REVIEW"),
    "NAME003": ("naming", "REVIEW"), "NAME004": ("naming", "SAFE_FIX"),
    "NAME005": ("naming", "REVIEW"), "NAME006": ("naming", "REVIEW"),
    "SERIES_IDENTITY_MIX": ("identity", "BLOCKER"),
    "PARTIAL_VOLUME_TAGGING": ("identity", "BLOCKER"),
    "KAVITA_VOLUME_JUMP_RISK": ("identity", "REVIEW/BLOCKER"),
    "DUPLICATE_CHAPTER_IDENTITY": ("identity", "BLOCKER"),
    "UNDOCUMENTED_VOLUME_FALLBACK": ("identity", "BLOCKER"),
    "CONFIRMED_SOURCE_GAP": ("identity", "INFO"),
    "UNINTENDED_GAP": ("identity", "REVIEW"),
    "USER_IGNORED_DAMAGED_ITEM": ("identity", "INFO"),
    "FALLBACK_COVERED_UNNUMBERED_RANGE": ("identity", "INFO/REVIEW"),
    "UNMAPPED_SOURCE_ABSENCE": ("identity", "REVIEW"),
    "ARC001": ("archive", "WARNING"), "ARC002": ("archive", "BLOCKER"),
    "ARC003": ("archive", "BLOCKER"), "ARC004": ("archive", "SAFE_FIX"),
    "ARC005": ("archive", "SAFE_FIX"), "ARC006": ("archive", "REVIEW"),
    "ARC007": ("archive", "BLOCKER"), "ARC008": ("archive", "BLOCKER"),
    "ARC009": ("archive", "SAFE_FIX"), "ARC010": ("archive", "BLOCKER"),
    "PAGE001": ("page", "SAFE_FIX"), "PAGE002": ("page", "REVIEW"),
    "PAGE003": ("page", "WARNING"), "PAGE004": ("page", "BLOCKER"),
    "PAGE005": ("page", "SAFE_FIX/REVIEW"), "PAGE006": ("page", "INFO/REVIEW"),
    "PAGE007": ("page", "WARNING"), "PAGE008": ("page", "WARNING"),
    "PDF001": ("document", "BLOCKER"), "PDF002": ("document", "WARNING"),
    "PDF003": ("document", "BLOCKER"), "PDF004": ("document", "BLOCKER"),
    "PDF005": ("document", "WARNING"), "PDF006": ("document", "BLOCKER"),
    "EPUB001": ("document", "PRESERVE"), "EPUB002": ("document", "BLOCKER"),
    "EPUB003": ("document", "BLOCKER"),
    "META001": ("metadata", "REVIEW"), "META002": ("metadata", "REVIEW"),
    "META003": ("metadata", "REVIEW"), "META004": ("metadata", "BLOCKER"),
    "META005": ("metadata", "SAFE_FIX/REVIEW"), "META006": ("metadata", "REVIEW"),
    "META007": ("metadata", "REVIEW"), "META008": ("metadata", "REVIEW"),
    "META009": ("metadata", "REVIEW"), "META010": ("metadata", "REVIEW"),
    "META011": ("metadata", "BLOCKER"), "META012": ("metadata", "REVIEW"),
    "SPECIAL_RANGE_INCOMPLETE": ("run", "REVIEW"),
    "SPECIAL_DUPLICATE_PAGE": ("run", "INFO/REVIEW"),
    "RESUME_SOURCE_CHANGED": ("run", "BLOCKER"),
    "RESUME_BASELINE_CHANGED": ("run", "BLOCKER"),
    "PROMOTION_POSTCHECK_FAILED": ("run", "BLOCKER"),
}
