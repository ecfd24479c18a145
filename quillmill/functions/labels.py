"""Short labels: which service an address belongs to, what an error means to a user, and what a source is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of addresses with the service's label; parts of error texts with what is said instead, in the order tried.
PROVIDERS = [("siliconflow", "SiliconFlow"), ("deepseek", "DeepSeek"), ("openai", "OpenAI"), ("hunyuan", "Hunyuan")]
ERRORS = [
    (["401", "Unauthorized"], "API Key 无效或已过期，请在设置中更新"),
    (["429", "Too Many Requests"], "请求过于频繁或额度不足，请稍后重试"),
    (["402"], "API 额度不足，请检查账户余额"),
    (["500", "502", "503"], "API 服务暂时不可用，请稍后重试"),
    (["timeout", "ETIMEDOUT", "ECONNREFUSED"], "网络连接超时，请检查 API URL 或网络设置"),
    (["Failed to fetch", "network"], "网络连接失败，请检查网络或 API URL"),
]


def provider(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(*[F.when(F.contains(low, F.lit(part)), name) for part, name in PROVIDERS], F.lit("AI"))


def friendly_error(message: Column) -> Column:
    """The first text whose parts the message holds; any other message stays."""
    said = [F.when(message.rlike("|".join(parts)), text) for parts, text in ERRORS]
    return F.coalesce(*said, message)


def source_title(kind: Column, content: Column) -> Column:
    """The host of an address; of everything else, and of addresses without one, the first fifty characters."""
    host = F.lower(F.regexp_extract(content, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    start = F.substring(content, 1, 50)
    return F.when((kind == "url") & (host != ""), host).otherwise(start)
