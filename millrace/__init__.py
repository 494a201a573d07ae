"""Agent-run analytics on Spark: text and JSON extraction, state machines, option chains, schedules."""
