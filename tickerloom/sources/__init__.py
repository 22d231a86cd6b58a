"""Readers: typed dataset scans, landed payloads and stored artifacts."""
