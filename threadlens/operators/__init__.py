"""threadlens.operators"""
