"""Sources and sinks: bodies, event frames, rules, audit."""
