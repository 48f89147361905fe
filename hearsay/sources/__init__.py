"""Reading tables and payloads, writing exports."""
