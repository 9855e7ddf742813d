"""threadlens.functions"""
