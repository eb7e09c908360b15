"""Zone manifests: how datasets are laid out, described and pruned."""
