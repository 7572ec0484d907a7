"""Sources and sinks: directories, archives, repositories and ignore files."""
