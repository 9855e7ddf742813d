"""threadlens.streaming"""
