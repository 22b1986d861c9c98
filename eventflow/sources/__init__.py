"""Sources, schedules, polling and sinks."""
