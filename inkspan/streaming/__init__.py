"""The pipeline as two streaming queries over topics in folders, and stateful checks of the job log."""
