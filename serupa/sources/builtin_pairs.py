"""Built-in labelled title pairs."""

# judul_a, judul_b, label (1 similar, 0 different).
PAIRS = (
    (
        "Implementasi Algoritma K-Nearest Neighbor untuk Klasifikasi Penyakit Diabetes",
        "Penerapan Metode K-Nearest Neighbor dalam Klasifikasi Diabetes Mellitus",
        1,
    ),
    (
        "Sistem Informasi Manajemen Perpustakaan Berbasis Web",
        "Rancang Bangun Sistem Informasi Perpustakaan Berbasis Web",
        1,
    ),
    (
        "Deteksi Penyakit Tanaman Padi Menggunakan Convolutional Neural Network",
        "Klasifikasi Penyakit Pada Tanaman Padi Berbasis CNN",
        1,
    ),
    (
        "Aplikasi Monitoring Kehadiran Mahasiswa Berbasis Android",
        "Sistem Absensi Mahasiswa Menggunakan Aplikasi Mobile Android",
        1,
    ),
    (
        "Sistem Rekomendasi Film Menggunakan Collaborative Filtering",
        "Implementasi Collaborative Filtering untuk Rekomendasi Film",
        1,
    ),
    (
        "Analisis Sentimen Ulasan Produk E-commerce Menggunakan Naive Bayes",
        "Klasifikasi Sentimen Review Toko Online dengan Metode Naive Bayes",
        1,
    ),
    (
        "Prediksi Harga Rumah Menggunakan Algoritma Random Forest",
        "Peramalan Harga Properti Berbasis Random Forest Regression",
        1,
    ),
    (
        "Sistem Deteksi Wajah Menggunakan Metode Viola-Jones",
        "Implementasi Face Detection dengan Algoritma Viola-Jones",
        1,
    ),
    (
        "Rancang Bangun Aplikasi Point of Sale Berbasis Web untuk UMKM",
        "Pengembangan Sistem Kasir Point of Sale Berbasis Website untuk Usaha Kecil Menengah",
        1,
    ),
    (
        "Optimasi Rute Pengiriman Menggunakan Algoritma Dijkstra",
        "Penerapan Algoritma Dijkstra untuk Pencarian Rute Terpendek pada Sistem Logistik",
        1,
    ),
    (
        "Implementasi Blockchain untuk Keamanan Data Rekam Medis",
        "Sistem Rekomendasi Musik Menggunakan Collaborative Filtering",
        0,
    ),
    (
        "Analisis Performa Algoritma Sorting pada Big Data",
        "Desain Antarmuka Aplikasi Mobile untuk Manajemen Keuangan",
        0,
    ),
    (
        "Pendeteksian Hoaks di Media Sosial Menggunakan LSTM",
        "Sistem Informasi Geografis untuk Pemetaan Lokasi UMKM",
        0,
    ),
    (
        "Implementasi Internet of Things untuk Sistem Smart Home",
        "Klasifikasi Teks Berita Menggunakan Support Vector Machine",
        0,
    ),
    (
        "Pengembangan Game Edukasi Matematika untuk Siswa SD",
        "Analisis Kualitas Air Sungai Menggunakan Sensor IoT",
        0,
    ),
    (
        "Sistem Pemantauan Cuaca Real-time Berbasis IoT",
        "Rancang Bangun Aplikasi E-Learning untuk Madrasah",
        0,
    ),
    (
        "Penerapan Transfer Learning untuk Klasifikasi Citra Batik",
        "Sistem Manajemen Inventory Gudang Berbasis RFID",
        0,
    ),
    (
        "Enkripsi Data Menggunakan Algoritma AES-256",
        "Prediksi Curah Hujan Menggunakan Artificial Neural Network",
        0,
    ),
    (
        "Pengembangan Chatbot Layanan Pelanggan Menggunakan NLP",
        "Simulasi Jaringan Komputer dengan Cisco Packet Tracer",
        0,
    ),
    (
        "Visualisasi Data COVID-19 di Indonesia Menggunakan D3.js",
        "Implementasi Fingerprint Authentication pada Sistem Absensi",
        0,
    ),
    (
        "Sistem Informasi Akademik Berbasis Web",
        "Aplikasi Pengolahan Data Nilai Mahasiswa Berbasis Website",
        1,
    ),
    (
        "Deteksi Objek pada Citra Menggunakan YOLO",
        "Klasifikasi Gambar Menggunakan Convolutional Neural Network",
        0,
    ),
)
