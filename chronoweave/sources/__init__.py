"""Readers of subtitles, manifests, drafts and project files."""
