"""Sources and sinks: delivery folders, text lines, delimited tables, event logs, rules, findings."""
