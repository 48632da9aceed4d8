"""The word, tag and host lists of the editorial rules, in their natural order."""

from __future__ import annotations

# Tags of news that can be acted on.
ACTIONABLE_TAGS = ("model_release", "product_update", "api_platform", "developer_tools", "ai_agents", "enterprise_ai", "infrastructure", "funding", "partnership", "acquisition", "regulation", "safety", "government",)
# Tags that make a repository significant.
GITHUB_TAGS = ("model_release", "product_update", "api_platform", "developer_tools", "ai_agents", "enterprise_ai", "infrastructure", "open_source",)
# Tags with consequences for the ecosystem.
ECOSYSTEM_TAGS = ("product_update", "api_platform", "enterprise_ai", "infrastructure", "developer_tools", "ai_agents", "model_release", "regulation", "safety", "government", "partnership", "acquisition", "funding",)
# Signs that a repository is in use.
ADOPTION_HINTS = ("adoption", "adopted", "used by", "integrated", "integration", "sdk", "api", "enterprise", "production", "deploy", "deployment", "mcp", "agent sdk", "ecosystem",)
# Signs of an effect on the ecosystem.
SOCIETY_ECOSYSTEM_HINTS = ("enterprise", "developers", "developer", "api", "sdk", "platform", "ecosystem", "distribution", "compliance", "security", "infrastructure", "pricing", "deployment", "model access", "operator", "workflow",)
# Signs of personal writing.
SOCIETY_FILLER_HINTS = ("personal reflection", "personal reflections", "my thoughts", "thoughts on", "what i learned", "lessons learned", "opinion", "essay", "journal", "reflections on", "musings", "blog post",)
# Tags of high consequence.
CONSEQUENCE_TAGS = ("regulation", "safety", "government", "infrastructure", "enterprise_ai",)
# Signs of high consequence.
CONSEQUENCE_HINTS = ("regulation", "policy", "compliance", "licensing", "export controls", "safety", "alignment", "security", "breach", "compute", "datacenter", "data center", "infrastructure", "power grid", "chip export", "foundation model",)
# Tags of news that regional media repeat.
PROXY_TAGS = ("product_update", "api_platform", "model_release", "enterprise_ai", "funding", "partnership", "acquisition",)
# Signs of workflow.
WORKFLOW_HINTS = ("workflow", "workflow automation", "agent workflow", "orchestration", "orchestrator", "handoff", "handoffs", "multi-step workflow", "multi step workflow", "review loop", "approval loop", "human-in-the-loop", "human in the loop", "human review", "tool use", "tool-use",)
# Signs of health care.
HEALTHCARE_HINTS = ("clinic", "clinical", "healthcare", "medical", "patient workflow", "patient support", "patient scheduling", "scheduling", "appointment", "intake", "triage",)
# Signs of operations.
OPERATIONS_HINTS = ("operations", "system automation", "monitoring", "observability", "reliability", "incident response", "runbook", "guardrails", "eval", "evaluation",)
# Signs of deployment.
DEPLOYMENT_HINTS = ("simulation", "simulator", "scenario", "scenario-based", "deployment", "deployable", "local deployment", "private deployment", "local-first", "local first", "on-device", "on device", "edge deployment", "self-hosted", "self hosted", "cost-aware deployment", "cost-aware",)
# Signs of value to operators, beside the four lists above.
OPERATOR_BASE = ("api", "sdk", "platform", "developer", "developers", "enterprise", "integration", "workflow", "deployment", "pricing", "security", "compliance", "infrastructure", "benchmark", "agent", "agents", "model", "release", "launch", "rollout",)
# Signs of something new.
NOVELTY_HINTS = ("release", "released", "launch", "launched", "announce", "announced", "introduces", "introduced", "new model", "new api", "new sdk", "general availability", "ga", "preview", "public beta", "open source", "open-source", "pricing", "partner", "partners with", "acquisition", "funding",)
# Signs of promotion.
PROMO_HINTS = ("register now", "get your ticket", "tickets are limited", "webinar", "conference", "summit", "join us", "event",)
# Signs of speculation.
SPECULATION_HINTS = ("rumor", "rumour", "speculation", "unverified", "what could go wrong", "might", "could", "reportedly", "leak",)
# Signs of a repository of little value.
GITHUB_NOISE_HINTS = ("tutorial", "guide", "boilerplate", "starter kit", "starter", "template", "templates", "prompt pack", "prompt-pack", "plugin", "plugins", "workflow kit", "example", "examples", "awesome list", "collection of",)
# Owners of repositories that count as major.
MAJOR_OWNERS = ("openai", "anthropics", "langchain-ai", "huggingface", "microsoft", "google", "google-deepmind", "deepmind", "meta", "facebookresearch", "nvidia", "vercel",)
# Title signals: workflow systems.
WORKFLOW_SIGNALS = ("agent workflow", "workflow automation", "multi-step workflow", "multi step workflow", "orchestration", "orchestrator", "handoff", "handoffs", "review loop", "approval loop", "human-in-the-loop", "human in the loop", "tool use", "tool-use",)
# Title signals: health care workflows.
HEALTHCARE_SIGNALS = ("ai clinic", "clinic workflow", "clinical workflow", "healthcare workflow", "medical workflow", "patient workflow", "patient scheduling", "appointment automation", "intake automation", "medical triage",)
# Title signals: operations.
RELIABILITY_SIGNALS = ("operations workflow", "system automation", "model monitoring", "observability", "reliability", "incident response", "runbook", "guardrails", "human review", "eval", "evaluation",)
# Title signals: simulation and deployment.
DEPLOYMENT_SIGNALS = ("simulation", "simulator", "scenario", "scenario-based", "local deployment", "private deployment", "local-first", "local first", "on-device", "on device", "edge deployment", "self-hosted", "self hosted", "cost-aware deployment", "cost-aware",)
# Strategic words of a title.
STRATEGIC_WORDS = ("open-source", "open source", "dominance", "partnership", "partners with", "market lead", "threatens", "race", "ecosystem", "infrastructure", "robotics", "advisory body", "warns", "competition", "agent workflow", "workflow automation", "orchestration", "multi-step workflow", "human-in-the-loop", "clinic workflow", "healthcare workflow", "medical workflow", "patient workflow", "operations workflow", "system automation", "model monitoring", "observability", "reliability", "incident response", "simulation", "simulator", "scenario-based", "local deployment", "private deployment", "on-device", "edge deployment", "self-hosted",)
# Business words.
BUSINESS_WORDS = ("startup", "funding", "gọi vốn", "goi von", "partnership", "partners with", "market", "competition", "competitive", "cạnh tranh", "canh tranh", "race", "lead", "dominance", "robotics", "chiến lược", "chien luoc",)
# Policy words.
POLICY_WORDS = ("law", "regulation", "policy", "governance", "compliance", "safety", "security", "cyberattack", "cyber attack", "breach", "compromise", "hack", "hacked", "leak", "lawsuit", "investigation",)
# Society words.
SOCIETY_WORDS = ("ecosystem", "student", "students", "education", "community",)
# Words of titles out of scope.
OFF_SCOPE_WORDS = ("smartphone", "camera", "melania trump", "meteor", "mảnh thiên thạch", "thien thach", "dịch vụ công", "dich vu cong", "weather", "football", "showbiz",)
# Words of editorial noise.
NOISE_WORDS = ("task manager", "quan ly tac vu", "quản lý tác vụ", "任务管理器", "win10", "win11", "jingyan", "điện thoại", "dien thoai", "smartphone", "camera", "mặt trăng", "mat trang", "xăng dầu", "xang dau", "dầu mỏ", "dau mo", "sephora", "benefit", "geforce now",)
# Hosts never taken.
BLOCKED_HOSTS = ("wikipedia.org", "tripadvisor.com", "amazon.com", "ebay.com", "linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "pinterest.com", "yelp.com", "booking.com", "bing.com", "search.yahoo.com", "yahoo.com", "doubleclick.net", "googleadservices.com", "dichvucong.gov.vn", "support.google.com", "stackoverflow.com",)
# Hosts of search results that are noise.
SUPPLEMENTAL_BLOCKED_HOSTS = ("tudientiengviet.org", "rung.vn",)
# Hosts of search results that are trusted.
TRUSTED_HOSTS = ("openai.com", "anthropic.com", "ai.meta.com", "about.fb.com", "blog.google", "googleblog.com", "deepmind.google", "huggingface.co", "mistral.ai", "aws.amazon.com", "techcrunch.com", "theverge.com", "arstechnica.com", "news.mit.edu", "genk.vn", "nvidianews.nvidia.com", "blogs.microsoft.com", "databricks.com", "cloudflare.com", "cnbc.com",)
# Hosts of search results to be reviewed.
REVIEW_HOSTS = ("substack.com", "newatlas.com", "fortune.com", "marktechpost.com", "biopharmatrend.com", "erp.today", "perplexity.ai", "thenewstack.io", "vnptai.io", "vneconomy.vn",)
# Hosts of search results that are left out.
LOW_QUALITY_HOSTS = ("analyticsinsight.net", "cometapi.com", "digitalapplied.com", "free-llm.com", "grokipedia.com", "intuitionlabs.ai", "iq.com", "mem0.ai", "newmarketpitch.com",)
# Signals that a search result must have.
FOUNDER_SIGNALS = ("ai", "a.i", "artificial intelligence", "tri tue nhan tao", "trí tuệ nhân tạo", "llm", "model", "agent", "api", "openai", "anthropic", "claude", "gpt", "chatgpt", "gemini", "deepmind", "xai", "grok", "huggingface", "hugging face", "nvidia", "research", "benchmark", "inference", "training", "robot", "robotics", "startup", "funding", "enterprise", "automation", "chip", "gpu", "regulation", "policy", "vietnam", "mcp", "cursor", "copilot", "prompt", "workflow", "ứng dụng ai", "công cụ ai", "mô hình", "dữ liệu", "nghiện ai", "openclaw", "deep learning", "machine learning", "fine-tune", "finetune", "rag", "vector", "embedding", "transformer", "diffusion", "stable diffusion", "midjourney", "sora", "llama", "mistral", "qwen", "phi-", "microsoft", "google", "meta ai", "apple intelligence",)
# Noise that a search result must not have.
FOUNDER_NOISE = ("task manager", "quan ly tac vu", "quản lý tác vụ", "任务管理器", "win10", "win11", "smartphone", "điện thoại", "dien thoai", "camera", "xăng dầu", "xang dau", "dầu mỏ", "dau mo", "mặt trăng", "mat trang", "sephora", "benefit", "geforce now", "skincare",)
# Hosts that hold no news.
NON_NEWS_HOSTS = ("bing.com", "search.yahoo.com", "yahoo.com", "doubleclick.net", "googleadservices.com", "dichvucong.gov.vn", "stackoverflow.com", "support.google.com",)
# Parts of URLs that hold no news.
NON_NEWS_URL_PARTS = ("aclick", "/search?", "/search;", "/ads/", "/p/home/", "/home/dvc-",)
# Parts of URLs of articles.
ARTICLE_URL_PARTS = ("/news/", "/blog/", "/posts/", "/article", "/press", "/stories/",)
# Title words of entertainment and gadgets.
SHOW_WORDS = ("gaming glasses", "ar glasses", "music review", "album review", "film", "movie", "tv show", "headphones", "speaker", "camera", "gaming",)
# Title words near the topic, beside the lists above.
TOPIC_BASE = ("ai", "agent", "model", "llm", "openai", "anthropic", "claude", "gpt", "deepmind", "gemini", "meta", "xai", "grok", "hugging face", "nvidia", "robot", "robotics", "chip", "inference", "training", "benchmark", "research", "startup", "funding", "acquisition", "partnership", "regulation", "policy",)
TOPIC_MORE = ("simulation", "scenario-based", "local deployment", "private deployment", "on-device", "edge deployment",)
# Words of strategic weight, beside the lists above.
STRATEGIC_BASE = ("openai", "anthropic", "claude", "gpt", "gemini", "deepmind", "xai", "grok", "agent", "agents", "api", "sdk", "platform", "model", "llm", "research", "benchmark", "inference", "training", "chip", "gpu", "startup", "funding", "revenue", "enterprise", "workflow", "automation", "orchestration", "handoff", "review loop", "approval loop", "multi-step", "multi step", "human-in-the-loop", "human in the loop", "tool use", "tool-use", "healthcare", "medical", "clinic", "patient", "patient workflow", "scheduling", "appointment", "intake", "triage", "operations", "system automation", "monitoring", "observability", "reliability", "incident response", "runbook", "guardrails", "simulation", "scenario", "simulator", "local deployment", "private deployment", "local-first", "local first", "on-device", "on device", "edge deployment", "self-hosted", "self hosted", "cost-aware", "cost-aware deployment", "robot", "robotics", "regulation", "policy", "safety", "security", "vietnam", "asean",)

OPERATOR_HINTS = tuple(dict.fromkeys(OPERATOR_BASE + WORKFLOW_HINTS + HEALTHCARE_HINTS + OPERATIONS_HINTS + DEPLOYMENT_HINTS))
TOPIC_SIGNALS = tuple(dict.fromkeys(TOPIC_BASE + WORKFLOW_SIGNALS + HEALTHCARE_SIGNALS + RELIABILITY_SIGNALS + TOPIC_MORE))
STRATEGIC_SIGNALS = tuple(dict.fromkeys(STRATEGIC_BASE + WORKFLOW_SIGNALS + HEALTHCARE_SIGNALS + RELIABILITY_SIGNALS + DEPLOYMENT_SIGNALS))
