"""Sources and sinks: files and landed JSON in, tables and text out. Network access is outside: land its results as files."""
