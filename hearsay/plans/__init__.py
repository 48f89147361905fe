"""Jobs composed of operators: ingesting payloads, reporting on keywords."""
