"""Where records come from and go to: topics as folders, files, web endpoints."""
