"""Agent-telemetry analytics as composable Spark DataFrame functions."""
