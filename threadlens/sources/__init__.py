"""threadlens.sources"""
