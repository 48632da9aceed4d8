"""Run parameters and fixed values of the editorial rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Priority of each kind of source.
KIND_PRIORITY = {"official": 95, "github": 90, "strong_media": 85, "watchlist": 82, "regional_media": 80, "community": 74, "manual": 70, "search": 66, "review": 58, "unknown": 45}
# Hosts of each kind of source.
OFFICIAL = ("openai.com", "anthropic.com", "ai.meta.com", "about.fb.com", "blog.google", "deepmind.google", "huggingface.co", "mistral.ai", "blogs.microsoft.com", "nvidianews.nvidia.com", "aws.amazon.com", "databricks.com", "cloudflare.com")
STRONG_MEDIA = ("techcrunch.com", "theverge.com", "arstechnica.com", "news.mit.edu", "cnbc.com", "reuters.com", "bloomberg.com")
REGIONAL_MEDIA = ("vnexpress.net", "vietnamnet.vn", "vtv.vn", "genk.vn", "nhandan.vn")
# Hours up to which an item has each freshness.
FRESHNESS = (("breaking", 24), ("fresh", 72), ("recent", 168), ("aging", 720))
# Points of the prefilter by tier and freshness.
TIER_POINTS = {"a": 10, "b": 7, "c": 3, "unknown": 1}
FRESHNESS_POINTS = {"breaking": 10, "fresh": 8, "recent": 5, "aging": -3, "stale": -8, "unknown": 0}
# Caps of the three score components.
COMPONENT_CAPS = (33, 33, 34)
# Fixed values: (eligible from, review from, least operator strength) by kind of source.
ROUTE_THRESHOLDS = {"official": (50, 42, 4), "watchlist": (52, 44, 4), "strong_media": (56, 48, 4), "regional_media": (68, 62, 6), "manual": (62, 54, 5), "review": (62, 54, 5), "search": (64, 56, 5), "unknown": (62, 54, 5)}
LANES = ("Product", "Society & Culture", "Practical")
# Label of a feedback text and the phrases that give it.
FEEDBACK_PHRASES = {
    "stale": ("cũ", "tin cu", "stale", "old news", "không mới", "khong moi"),
    "weak_source": ("nguồn yếu", "nguon yeu", "source yếu", "source yeu", "không tin", "khong tin"),
    "not_relevant": ("không liên quan", "khong lien quan", "not relevant", "irrelevant"),
    "want_more_depth": ("đào sâu", "dao sau", "deeper", "chi tiết hơn", "chi tiet hon"),
    "good_pick": ("hay", "tốt", "tot", "good pick", "ổn", "on"),
    "founder_lens": ("founder", "sếp", "sep", "operator", "startup"),
    "skip_delivery": ("không nên lên brief", "khong nen len brief", "đừng lên brief", "dung len brief"),
    "promote_delivery": ("nên lên brief", "nen len brief", "đưa lên brief", "dua len brief"),
}
# Whole messages that are commands, and their labels.
FEEDBACK_COMMANDS = {
    "cũ": "stale",
    "tin cũ": "stale",
    "nguồn yếu": "weak_source",
    "không liên quan": "not_relevant",
    "dang doc": "good_pick",
    "đáng đọc": "good_pick",
    "đào sâu hơn": "want_more_depth",
    "uu tien founder": "founder_lens",
    "ưu tiên founder": "founder_lens",
    "không nên lên brief": "skip_delivery",
    "khong nen len brief": "skip_delivery",
    "nên lên brief": "promote_delivery",
    "nen len brief": "promote_delivery",
}
# Words that tell of a wrong type, and the types that may be named after them, first match first.
WRONG_TYPE = ("sai loại", "sai loai")
EXPECTED_TYPES = ("research", "product", "business", "policy", "society", "practical")
# Names of the watchlist's kinds on topic pages, in the order of the pages' terms.
TOPIC_GROUPS = {"companies": "Company", "products": "Product", "tools": "Tool", "policy": "Policy", "topics": "Topic"}
# Words left out of title tokens and themes.
TITLE_STOPWORDS = (
    "the", "a", "an", "and", "or", "for", "with", "into", "from", "that", "this", "news", "today", "latest", "update", "updates", "report", "reports", "says", "new", "launches", "launch", "announces", "introduces", "about", "after",
    "tai", "cua", "cho", "voi", "trong", "mot", "nhung", "nhat", "moi", "bao", "ve", "sau", "tren", "khi", "nguoi", "viet", "nam", "tri", "tue", "nhan", "tao",
)

# Hosts that are always near the topic, words of the topic, words of other topics.
TOPIC_HOSTS = ("openai.com", "anthropic.com", "about.fb.com", "deepmind.google", "ai.googleblog.com", "huggingface.co", "developer.nvidia.com", "research.google", "aws.amazon.com", "blogs.microsoft.com", "nvidianews.nvidia.com")
TOPIC_WORDS = r"\b(ai|artificial intelligence|tri tue nhan tao|trí tuệ nhân tạo|llm|model|agent|agents|openai|anthropic|claude|gpt|gemini|deepmind|hugging face|huggingface|xai|grok|nvidia|inference|training|transcription|asr|benchmark|robotics|robot|chip|gpu)\b"
OFF_TOPIC_WORDS = r"\b(oil|tankers|hormuz|iran|middle east|zelenskyy|ukraine aid|troops|stocks|wall street|private credit|saudi|football|showbiz|weather|iphone case|camera roundup|celebrity|ios|iphone|ipad|apple music|sleep tracking|playlist|playstation|ps5)\b"


@dataclass(frozen=True)
class SourcePolicy:
    """Which hosts are official, strong or regional media; tiers; hosts and URL parts that hold no news."""

    official: tuple[str, ...] = OFFICIAL
    strong_media: tuple[str, ...] = STRONG_MEDIA
    regional_media: tuple[str, ...] = REGIONAL_MEDIA
    tier_a: tuple[str, ...] = OFFICIAL
    tier_b: tuple[str, ...] = STRONG_MEDIA + REGIONAL_MEDIA
    blocked_hosts: tuple[str, ...] = ()
    landing_parts: tuple[str, ...] = ()
    generic_titles: tuple[str, ...] = ("xai",)
    marketing_phrases: tuple[str, ...] = ("trusted by", "get started")


@dataclass(frozen=True)
class RunConfig:
    """What a run is given: its time, how many rows a stage lets through, and the source policy."""

    now: str = "2024-01-31 00:00:00"
    max_candidates: int = 25
    min_score: int = 60
    policy: SourcePolicy = field(default_factory=SourcePolicy)
