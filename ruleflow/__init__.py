"""ruleflow: rule-aware comment moderation data work, written as Spark DataFrame jobs."""
